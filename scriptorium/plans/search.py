"""Full-text queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stemming import stem
from ..operators import fulltext as S
from ..session import spread
from ..sources import archive as A
from .registry import Catalogue

C = Catalogue()

QUERY, PHRASE, LIST = "then that re", "of-the", "scum idiot"


def tok(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(lower({x}), '{X.ACCENTED}', '{X.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


FIRST = "left(split_part(coalesce(text, ''), chr(10), 1), 80)"
DOCS = f"d AS (SELECT doc_id, {tok(FIRST)} AS title, {tok("coalesce(text, '')")} AS body FROM documents)"


def docs(spark: SparkSession, sf: str, stemmed: bool = False) -> DataFrame:
    return S.documents(spread(A.read(spark, sf, "documents").select("doc_id", "text")), stemmed)


@lru_cache(16)
def _indexed(application: str, sf: str, stemmed: bool) -> S.TextIndex:
    spark = SparkSession.getActiveSession()
    index = S.TextIndex(spark, stemmed=stemmed)
    index.add(docs(spark, sf, stemmed))
    return index


def text_index(spark: SparkSession, sf: str, stemmed: bool = False) -> S.TextIndex:
    """The documents' index, written once an application: a search engine's queries read a stored index."""
    return _indexed(spark.sparkContext.applicationId, sf, stemmed)


def hit_sql(phrase: S.Phrase, column: str, forms: bool = False) -> str:
    """Hits of a phrase in a list of words; with ``forms`` its tokens are stems, and any word of that stem hits."""
    n = len(phrase.tokens)
    if forms:
        listed = {w: "('" + "', '".join(words_of(w)) + "')" for w in phrase.tokens}
        test = " AND ".join(f"coalesce({column}[i + {k}] IN {listed[w]}, false)" for k, w in enumerate(phrase.tokens))
        return f"len(list_filter(range(1, len({column}) + 1), lambda i: {test}))"
    one = lambda e, w, prefix: f"starts_with({e}, '{w}')" if prefix else f"{e} = '{w}'"
    test = " AND ".join(f"coalesce({one(f'{column}[i + {k}]', w, phrase.prefix and k == n - 1)}, false)" for k, w in enumerate(phrase.tokens))
    return f"len(list_filter(range(1, len({column}) + 1), lambda i: {test}))"


def words_of(wanted: str) -> list[str]:
    """English inflections and derivations whose Porter stem is ``wanted``, itself included."""
    ends = ["", "s", "es", "ed", "ing", "e", "er", "ers", "est", "ly", "al", "ally", "ness", "ment", "ments", "able", "ation", "ations", "ive", "ize", "ful", "y", "ies", "ied", "ism", "ist"]
    bases = {wanted, wanted + wanted[-1], wanted[:-1] + "y" if wanted.endswith("i") else wanted}
    return sorted({b + e for b in bases for e in ends if stem(b + e) == wanted})


def bm25_sql(query: str, every: bool = True, weights: tuple[float, float] = (5.0, 1.0), limit: int = 20, forms: bool = False, rows: str = "d") -> str:
    phrases = S.parse(query, forms)
    fs = [f"({weights[0]} * {hit_sql(p, 'title', forms)} + {weights[1]} * {hit_sql(p, 'body', forms)})" for p in phrases]
    cols = ", ".join(f"{f} AS f{i}" for i, f in enumerate(fs))
    held = ", ".join(f"count(*) FILTER (f{i} > 0) AS h{i}" for i in range(len(fs)))
    idf = lambda i: f"greatest(ln((m.n - h.h{i} + 0.5) / (h.h{i} + 0.5)), 1e-6)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / m.l))" for i in range(len(fs)))
    match = (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(fs)))
    return f"""
WITH {DOCS}, m AS (SELECT count(*) AS n, avg(len(title) + len(body)) AS l FROM {rows}),
f AS (SELECT doc_id, len(title) + len(body) AS length, {cols} FROM {rows}), h AS (SELECT {held} FROM f)
SELECT doc_id, round({score}, 6) AS score FROM f, m, h WHERE {match} ORDER BY round({score}, 6) DESC, doc_id LIMIT {limit}"""


def top(scores: DataFrame, limit: int = 20) -> DataFrame:
    return scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


@C.query("search_bm25_topk", bm25_sql(QUERY))
def search_bm25_topk(spark, sf):
    return top(S.bm25(text_index(spark, sf), S.parse(QUERY)))


@C.query("search_scan", bm25_sql(QUERY))
def search_scan(spark, sf):
    """The same without an index."""
    return top(S.bm25(docs(spark, sf), S.parse(QUERY)))


@C.query("search_bm25_any", bm25_sql(LIST, every=False))
def search_bm25_any(spark, sf):
    return top(S.bm25(text_index(spark, sf), S.parse(LIST), every=False))


@C.query("search_bm25_weighted", bm25_sql("thti", weights=(2.0, 1.0)))
def search_bm25_weighted(spark, sf):
    return top(S.bm25(text_index(spark, sf), S.parse("thti"), {"title": 2.0, "body": 1.0}))


@C.query("search_phrase", bm25_sql(PHRASE))
def search_phrase(spark, sf):
    return top(S.bm25(text_index(spark, sf), S.parse(PHRASE)))


#: The sign at the end keeps the last word from being a prefix.
TERMS = 'idiot scum loser "'


@C.query("search_indexed_terms", bm25_sql(TERMS, every=False))
def search_indexed_terms(spark, sf):
    return top(S.bm25(text_index(spark, sf), S.parse(TERMS), every=False))


#: The sign at the end keeps the words before it from being prefixes.
STEMMED = 'idiots thing the"  "'


@C.query("search_stemmed", bm25_sql(STEMMED, forms=True))
def search_stemmed(spark, sf):
    return top(S.bm25(text_index(spark, sf, stemmed=True), S.parse(STEMMED, stemmed=True)))


KEPT = "k AS (SELECT * FROM d WHERE doc_id % 7 <> 3)"


@C.query("search_maintained_index", bm25_sql(QUERY, rows="k").replace(", m AS", f", {KEPT}, m AS", 1))
def search_maintained_index(spark, sf):
    """Half the documents, then the rest, some removed, some replaced, some added again."""
    d = docs(spark, sf)
    index = S.TextIndex(spark)
    index.add(d.where("doc_id % 2 = 0"))
    index.add(d.where("doc_id % 2 = 1"))
    index.remove(d.where("doc_id % 7 IN (3, 5)"))
    index.add(d.where("doc_id % 7 = 5"))
    index.replace(d.where("doc_id % 7 = 6"))
    return top(S.bm25(S.TextIndex.opened(spark, index.root), S.parse(QUERY)))


@C.query(
    "search_entries",
    f"""WITH x AS ({bm25_sql(LIST, limit=1_000_000_000)}),
b AS (SELECT doc_id AS entry_id, lang AS tag FROM documents UNION SELECT doc_id, 's' || right(source, 1) FROM documents
  UNION SELECT doc_id, 'quality-' || quality FROM labels UNION SELECT doc_id, 'toxic-' || toxic FROM labels)
SELECT doc_id AS id, source AS domain, score, (SELECT list_sort(list(tag)) FROM b WHERE entry_id = doc_id) AS tags FROM x JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0 ORDER BY score DESC, id LIMIT 20 OFFSET 2""",
)
def search_entries(spark, sf):
    """Entries divisible by 3 are gone, their postings are not."""
    entries = A.entries(spark, sf).where("id % 3 <> 0")
    found = S.search_entries(text_index(spark, sf), LIST, entries, A.content(spark, sf), A.entry_tags(spark, sf), 20, 2)
    return found.select("id", "domain", "score", "tags")


def total_sql(query: str) -> str:
    match = " AND ".join(f"({hit_sql(p, 'title')} + {hit_sql(p, 'body')}) > 0" for p in S.parse(query))
    return f"WITH {DOCS} SELECT count(*) AS total FROM d WHERE {match}"


@C.query("search_total", total_sql(QUERY))
def search_total(spark, sf):
    return S.total(text_index(spark, sf), QUERY)


@C.query("vocab_stats", f"WITH {DOCS}, w AS (SELECT doc_id, unnest(title || body) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM w GROUP BY term")
def vocab_stats(spark, sf):
    return S.vocabulary(docs(spark, sf))


@C.query(
    "search_snippet",
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\p{{Z}}\x{{85}}]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: list_contains({tok('w[i]')}, 'idiot'))), 1) AS spot FROM w
  WHERE len(list_filter(w, lambda x: list_contains({tok('x')}, 'idiot'))) > 0)
SELECT doc_id, CASE WHEN spot > 1 THEN '...' ELSE '' END || array_to_string(list_transform(w[spot : spot + 39],
  lambda x: CASE WHEN list_contains({tok('x')}, 'idiot') THEN '<mark>' || x || '</mark>' ELSE x END), ' ')
  || CASE WHEN len(w) > spot + 39 THEN '...' ELSE '' END AS snippet FROM p""",
)
def search_snippet(spark, sf):
    d = A.read(spark, sf, "documents").select("doc_id", "text")
    held = d.where(F.array_contains(X.tokens("text"), "idiot"))
    return held.select("doc_id", S.snippet(F.col("text"), ["idiot"]).alias("snippet"))


@C.query(
    "matched_page",
    "WITH p AS (SELECT doc_id AS entry_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page_num FROM documents) "
    "SELECT entry_id, CAST(min(page_num) AS INTEGER) AS page_num FROM p WHERE contains(lower(text), 'thti') GROUP BY entry_id",
)
def matched_page(spark, sf):
    """A line stands for a page."""
    lines = A.read(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return S.matched_page(lines.withColumn("page_num", F.col("n") + 1), "ThTi other")
