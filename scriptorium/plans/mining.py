"""Vectors, chunks, keywords, retrieval and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks, keywords, retrieval, topics, vectors
from ..operators import fulltext as S
from ..sources import archive as A
from .registry import Catalogue
from .search import DOCS, bm25_sql, docs, text_index

C = Catalogue()

COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"
PAIR = COS.format(a="a.embedding", b="b.embedding")


@C.query(
    "knn_topk",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({PAIR}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (0, 17, 42))
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 5""",
)
def knn_topk(spark, sf):
    found = vectors.neighbours(A.read(spark, sf, "embeddings"), [0, 17, 42], 5)
    return found.withColumn("similarity", F.round("similarity", 6))


@C.query(
    "knn_all_pairs_topk",
    f"""WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, {PAIR} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) <= 5""",
)
def knn_all_pairs_topk(spark, sf):
    return vectors.all_neighbours(A.read(spark, sf, "embeddings"), 5).withColumn("similarity", F.round("similarity", 6))


@C.query(
    "centroid_by_label",
    """SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[dim] AS DOUBLE)), 6) AS mean
FROM embeddings, range(1, 65) r(dim) GROUP BY label, dim""",
)
def centroid_by_label(spark, sf):
    return vectors.mean_by(A.read(spark, sf, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


@C.query("embedding_codec", "SELECT vec_id, 4 * len(embedding) AS bytes, embedding[1] AS first, embedding[-1] AS last FROM embeddings")
def embedding_codec(spark, sf):
    blob = A.read(spark, sf, "embeddings").select("vec_id", vectors.to_bytes("embedding").alias("blob"))
    back = blob.select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), vectors.from_bytes("blob").alias("v"))
    return back.select("vec_id", "bytes", F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"))


# Chunks: every vector is one of two neighbouring chunks of an entry. Questions: the vectors whose id is divisible by 50.
QUESTIONS = "q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0)"
SCORES = f"""s AS (SELECT query_id, vec_id // 2 AS entry_id, CAST(vec_id % 2 AS INTEGER) AS chunk_index, round({COS.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM q, embeddings e)"""


@C.query(
    "best_chunk_per_entry",
    f"""WITH {QUESTIONS}, {SCORES} SELECT query_id, entry_id, chunk_index, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id, entry_id ORDER BY score DESC, chunk_index) = 1""",
)
def best_chunk_per_entry(spark, sf):
    e = A.read(spark, sf, "embeddings")
    return vectors.best_in_groups(e.where("vec_id % 50 = 0"), e, F.floor(F.col("vec_id") / 2), lambda ids: ids % 2)


def _as_chunks(found):
    """Vectors as chunks of entries."""
    return found.select("query_id", F.floor(F.col("vec_id") / 2).alias("entry_id"), (F.col("vec_id") % 2).cast("int").alias("chunk_index"), F.round("similarity", 6).alias("score"))


#: Words that a question is searched by, in turn.
ASKED = ("the thti", "scum idiot", "then that re")


def _lexical_sql() -> str:
    """The full-text hits of every question, with their scores."""
    parts = []
    for n, text in enumerate(ASKED):
        ranked = bm25_sql(text, limit=1_000_000_000).strip().removeprefix(f"WITH {DOCS},").strip()
        parts.append(f"SELECT {n} AS turn, * FROM (WITH {ranked})")
    return f"x AS ({' UNION ALL '.join(parts)}), l AS (SELECT query_id, doc_id AS entry_id, score FROM q JOIN x ON x.turn = (query_id // 50) % {len(ASKED)})"


HYBRID_SQL = f"""WITH {DOCS}, {QUESTIONS}, {SCORES},
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id, chunk_index) <= 10),
{_lexical_sql()},
five AS (SELECT query_id, entry_id FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) <= 5),
k AS (SELECT s.query_id, s.entry_id, chunk_index, score * 0.8 AS score FROM s SEMI JOIN (SELECT * FROM five ANTI JOIN f USING (query_id, entry_id)) USING (query_id, entry_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, entry_id ORDER BY s.score DESC, chunk_index) = 1),
a AS (SELECT * FROM (SELECT * FROM f UNION ALL SELECT * FROM k) QUALIFY row_number() OVER (PARTITION BY query_id, entry_id ORDER BY score DESC, chunk_index) = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id, chunk_index) AS INTEGER) AS rank FROM a)
SELECT query_id, entry_id, chunk_index, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def lexical_hits(spark, sf):
    """``query_id, entry_id, score``: what the full-text index finds for each question."""
    index = text_index(spark, sf)
    found = None
    for n, text in enumerate(ASKED):
        one = S.bm25(index, S.parse(text)).select(F.lit(n).alias("turn"), F.col("doc_id").alias("entry_id"), F.round("score", 6).alias("score"))
        found = one if found is None else found.union(one)
    questions = A.read(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    turn = (F.floor(F.col("query_id") / 50) % len(ASKED)).cast("int")
    best = Window.partitionBy("turn").orderBy(F.desc("score"), "entry_id")  # a search returns its best five
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= retrieval.LEXICAL).drop("n")
    return questions.withColumn("turn", turn).join(found, "turn").drop("turn")


@C.query("hybrid_retrieve", HYBRID_SQL)
def hybrid_retrieve(spark, sf):
    e = A.read(spark, sf, "embeddings").select("vec_id", "embedding")
    questions = e.where("vec_id % 50 = 0")
    semantic = _as_chunks(vectors.nearest(questions, e, retrieval.SEMANTIC))
    hits = lexical_hits(spark, sf)
    # Similarities to a question are needed of the chunks of its few hits only.
    asked = questions.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    held = hits.select("query_id", "entry_id").join(asked, "query_id").join(e.withColumn("entry_id", F.floor(F.col("vec_id") / 2)), "entry_id")
    chunk_scores = _as_chunks(held.withColumn("similarity", vectors.cosine(F.col("asked"), F.col("embedding"))))
    return retrieval.hybrid(semantic, hits, chunk_scores).withColumn("score", F.round("score", 6))


@C.query("chunk_documents")
def chunk_documents(spark, sf):
    return chunks.chunked(A.content(spark, sf))


@C.query(
    "chunk_stats",
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
short AS (SELECT doc_id, t, 0 AS start, length(t) AS stop FROM d WHERE strlen(t) BETWEEN 100 AND 2000),
w AS (
  SELECT doc_id, t, 0 AS start, s AS stop FROM (SELECT doc_id, t, CASE WHEN length(t) <= 2000 THEN length(t) ELSE 1600 + coalesce(nullif(length(regexp_extract(substr(t, 1601, 401), '(?s)^(.*[.!?])\s', 1)), 0), 400) END AS s FROM d WHERE strlen(t) > 2000)
  UNION ALL
  SELECT doc_id, t, nxt, CASE WHEN nxt + 2000 >= length(t) THEN length(t) ELSE nxt + 1600 + coalesce(nullif(length(regexp_extract(substr(t, nxt + 1601, 401), '(?s)^(.*[.!?])\s', 1)), 0), 400) END
  FROM (SELECT doc_id, t, start + CASE WHEN stop > start + 400 THEN greatest(stop - start - 400, 1) ELSE 1600 END AS nxt FROM w) WHERE nxt < length(t)
), a AS (SELECT * FROM short UNION ALL SELECT * FROM w),
c AS (SELECT doc_id, regexp_replace(substr(t, start + 1, stop - start), '^\s+|\s+$', '', 'g') AS chunk FROM a)
SELECT doc_id AS entry_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM c WHERE strlen(chunk) >= 100 GROUP BY doc_id""",
)
def chunk_stats(spark, sf):
    c = chunks.chunked(A.content(spark, sf))
    return c.groupBy("entry_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("chunk_text")).alias("chars"))


@C.query("keywords_yake")
def keywords_yake(spark, sf):
    e = A.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.first_line("text").alias("title"), F.col("text").alias("extracted_text"))
    return keywords.entry_keywords(e, 5).withColumn("score", F.round("score", 9))


WORDS_AS_KEYWORDS = f"k AS (SELECT doc_id AS entry_id, w AS keyword, round(1.0 / (1 + min(i)), 9) AS score FROM (SELECT doc_id, unnest(title) AS w, generate_subscripts(title, 1) AS i FROM d) GROUP BY doc_id, w)"


@C.query("title_words_top", f"WITH {DOCS}, {WORDS_AS_KEYWORDS} SELECT keyword, count(*) AS count, min(score) AS best FROM k GROUP BY keyword ORDER BY count DESC, best, keyword LIMIT 20")
def title_words_top(spark, sf):
    return keywords.top_keywords(_title_words(spark, sf), 20)


def _title_words(spark, sf):
    """Words of titles, the earlier the better, in the form of stored keywords."""
    w = docs(spark, sf).select(F.col("doc_id").alias("entry_id"), F.posexplode("title").alias("i", "keyword"))
    return w.groupBy("entry_id", "keyword").agg(F.round(F.lit(1.0) / (F.lit(2) + F.min("i")), 9).alias("score"))


@C.query(
    "title_word_labels",
    f"""WITH {DOCS}, {WORDS_AS_KEYWORDS}, c AS (SELECT source, keyword, count(*) AS n, min(score) AS best FROM k JOIN documents ON doc_id = entry_id GROUP BY source, keyword
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, best, keyword) <= 3)
SELECT source AS topic, string_agg(keyword, ' / ' ORDER BY n DESC, best, keyword) AS label FROM c GROUP BY source""",
)
def title_word_labels(spark, sf):
    members = A.read(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), F.col("source").alias("topic"))
    return topics.labels(members, _title_words(spark, sf))


def _text_keywords(spark, sf):
    e = A.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.first_line("text").alias("title"), F.col("text").alias("extracted_text"))
    return keywords.entry_keywords(e)


@C.query("keywords_top")
def keywords_top(spark, sf):
    """The most frequent keywords of whole texts; tested against plain Python."""
    return keywords.top_keywords(_text_keywords(spark, sf), 20)


@C.query("topic_labels")
def topic_labels(spark, sf):
    """Labels from keywords of whole texts; tested against plain Python."""
    members = A.read(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), F.col("source").alias("topic"))
    return topics.labels(members, _text_keywords(spark, sf))


@C.query("topics_hdbscan")
def topics_hdbscan(spark, sf):
    return topics.clusters(A.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


#: Every fifth vector once more, under another id, slightly turned.
COPIED = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CASE WHEN i % 4 = 1 THEN 1.25 ELSE 1.0 END) FROM embeddings WHERE vec_id % 5 = 0)"


def _copied(spark, sf):
    e = A.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    turned = F.transform("embedding", lambda x, i: x * F.when(i % 4 == 0, 1.25).otherwise(1.0))
    return e.union(e.where("vec_id % 5 = 0").select(F.col("vec_id") + 1_000_000, turned))


def _pairs_sql(above: float) -> str:
    return f"WITH {COPIED} SELECT a.vec_id, b.vec_id AS neighbour, round({PAIR}, 6) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE {PAIR} > {above}"


@C.query("similar_pairs", _pairs_sql(0.4))
def similar_pairs(spark, sf):
    return vectors.similar_pairs(_copied(spark, sf), 0.4, block=200).withColumn("similarity", F.round("similarity", 6))


@C.query("near_duplicates", _pairs_sql(0.95))
def near_duplicates(spark, sf):
    return vectors.similar_pairs(_copied(spark, sf), 0.95).withColumn("similarity", F.round("similarity", 6))


@C.query(
    "context_budget",
    """WITH r AS (SELECT doc_id % 50 AS query_id, doc_id, text, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank FROM documents),
u AS (SELECT *, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM r)
SELECT query_id, doc_id, used_before, '[' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || ']' AS label FROM u WHERE used_before < 3000""",
)
def context_budget(spark, sf):
    rows = A.read(spark, sf, "documents").select((F.col("doc_id") % 50).alias("query_id"), "doc_id", F.col("text").alias("chunk_text"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return retrieval.within_budget(ranked).select("query_id", "doc_id", "used_before", "label")


TAIL = "h AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)"


@C.query("history_tail", f"WITH {TAIL} SELECT conv_id, turn, role FROM h")
def history_tail(spark, sf):
    return retrieval.history_tail(A.read(spark, sf, "conversations")).select("conv_id", "turn", "role")


def _prompt_sql(template: str) -> str:
    opening, closing, before, between, after, last = (x.replace("\n", "\\n").replace("'", "''") for x in retrieval.TEMPLATES[template])
    system = retrieval.SYSTEM.replace("\n", "\\n").replace("'", "''")
    role = "CASE WHEN role = 'user' THEN role ELSE 'model' END" if template == "gemma" else "role"
    turn = "''" if template == "gemma" else f"E'{before}user{between}'"
    return f"""WITH {TAIL} SELECT conv_id, E'{opening}{system}{closing}' || string_agg(E'{before}' || {role} || E'{between}' || text || E'{after}', '' ORDER BY turn) || {turn}
|| E'Sources:\\n[1] "Conversation ' || conv_id || E'"\\nA stored note.\\n\\nQuestion: What was said?{after}{last}' AS prompt FROM h GROUP BY conv_id"""


def _prompt(template: str):
    def run(spark, sf):
        tail = retrieval.history_tail(A.read(spark, sf, "conversations"))
        turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history")
        source = F.struct(F.lit("[1]").alias("label"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.lit("A stored note.").alias("text"))
        return tail.groupBy("conv_id").agg(turns).select("conv_id", retrieval.prompt(F.array(source), F.col("history"), F.lit("What was said?"), template).alias("prompt"))

    return run


for _t in retrieval.TEMPLATES:
    C.query(f"rag_prompt_{_t}", _prompt_sql(_t))(_prompt(_t))
