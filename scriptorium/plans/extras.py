"""Titles by a model, validation, backfills, contexts of questions, migrations and small labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import backfill as B
from ..operators import entries as E
from ..operators import retrieval, topics, vectors
from ..sources import archive as A
from ..sources import migrations as M
from . import mining
from .registry import Catalogue
from .relational import TRIM, WORDS, _clean_sql, _cut
from .saving import empty
from .search import FIRST

C = Catalogue()


def _quoted(text: str) -> str:
    return "E'" + text.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


def _title_prompt_sql(template: str) -> str:
    opening, closing, before, between, after, last = retrieval.TEMPLATES[template]
    turn = "" if template == "gemma" else f"{before}user{between}"
    head = _quoted(f"{opening}{E.TITLE_SYSTEM}{closing}{turn}What is the title of this document?\n\n")
    return f"SELECT doc_id, CASE WHEN strlen(text) >= 50 THEN {head} || left(text, 3000) || {_quoted(after + last)} END AS prompt FROM documents"


def _title_prompt(template: str):
    return lambda spark, sf: A.read(spark, sf, "documents").select("doc_id", E.title_prompt(F.col("text"), template).alias("prompt"))


for _t in retrieval.TEMPLATES:
    C.query(f"title_prompt_{_t}", _title_prompt_sql(_t))(_title_prompt(_t))


_ANSWER = "CASE doc_id % 4 WHEN 0 THEN '\"' || w || '\"' WHEN 1 THEN '  **' || w || '**' || chr(10) || 'because' WHEN 2 THEN '''' || w || '''' ELSE w END"


@C.query(
    "model_titles",
    rf"""WITH d AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')[1 : doc_id % 12], ' ') AS w FROM documents WHERE NOT contains(coalesce(text, ''), '"')),
a AS (SELECT doc_id, {_ANSWER} AS raw FROM d),
f AS (SELECT doc_id, split_part({TRIM.format('raw')}, chr(10), 1) AS t FROM a),
q AS (SELECT doc_id, CASE WHEN length(t) >= 2 AND ((starts_with(t, '"') AND ends_with(t, '"')) OR (starts_with(t, '''') AND ends_with(t, ''''))) THEN t[2 : -2] ELSE t END AS t FROM f),
b AS (SELECT doc_id, CASE WHEN length(t) >= 4 AND starts_with(t, '**') AND ends_with(t, '**') THEN t[3 : -3] ELSE t END AS t FROM q),
c AS (SELECT doc_id, {_clean_sql('t')} AS title FROM b)
SELECT doc_id, CASE WHEN strlen(title) BETWEEN 5 AND 200 THEN title END AS title FROM c""",
)
def model_titles(spark, sf):
    """Answers in quotes, in bold, with a second line: the title is the plain first line."""
    d = A.read(spark, sf, "documents").where(~F.coalesce("text", F.lit("")).contains('"'))
    beginning = F.regexp_extract(F.coalesce("text", F.lit("")), r"^(?:\s*+\S++){0,11}", 0)  # eleven words at most are taken
    words = F.array_join(F.slice(F.filter(F.split(beginning, r"\s+"), lambda x: x != ""), 1, (F.col("doc_id") % 12).cast("int")), " ")
    n = F.col("doc_id") % 4
    quoted = lambda w: F.when(n == 0, F.concat(F.lit('"'), w, F.lit('"'))).when(n == 1, F.concat(F.lit("  **"), w, F.lit("**\nbecause"))).when(n == 2, F.concat(F.lit("'"), w, F.lit("'"))).otherwise(w)
    raw = X.let(words, quoted)
    return d.select("doc_id", E.model_title(raw).alias("title"))


@C.query("model_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{m.id}', {m.size_bytes}, {m.context}, {m.least_ram_mb}, '{m.template}')" for m in E.MODELS) + ") m(id, size_bytes, context, least_ram_mb, template)")
def model_catalogue(spark, sf):
    return spark.createDataFrame([(m.id, m.size_bytes, m.context, m.least_ram_mb, E.template_of(m.id)) for m in map(E.model, [m.id for m in E.MODELS])], "id string, size_bytes long, context int, least_ram_mb int, template string")


@C.query("file_digests", "SELECT page_id, page_id % 3 <> 0 AS matches FROM pages")
def file_digests(spark, sf):
    content = F.encode("html", "UTF-8")
    digest = F.when(F.col("page_id") % 3 == 0, F.sha2(F.lit(b"other"), 256)).otherwise(F.upper(F.sha2(content, 256)))
    return A.read(spark, sf, "pages").select("page_id", E.digest_matches(content, digest).alias("matches"))


@C.query("to_retitle", "SELECT page_id AS id FROM pages WHERE (CAST(page_id AS VARCHAR) LIKE '1%' OR CAST(page_id AS VARCHAR) LIKE '2%') AND page_id % 5 < 3")
def to_retitle(spark, sf):
    n = F.col("page_id") % 5
    title = F.when(n == 0, " PDF ").when(n == 1, "untitled pdf").when(n == 2, "abc").otherwise("A long enough title")
    rows = A.read(spark, sf, "pages").select(F.col("page_id").alias("id"), title.alias("title"), F.col("page_id").alias("created_s"))
    return E.to_retitle(rows, ["1", "2"], only_generic=True).select("id")


_H1 = TRIM.format("replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*(>|$)', '', 'g'), '>', '')")


@C.query(
    "retitle_all",
    f"""WITH r AS (SELECT page_id AS id, CASE WHEN page_id % 3 = 1 THEN {_clean_sql(_cut(f'({_H1})', 150))} ELSE 'old' END AS title, {_clean_sql(_cut(f'({_H1})', 150))} AS new FROM pages WHERE page_id % 3 <> 2)
SELECT id, new AS title FROM r WHERE new <> title AND strlen(new) >= 5 UNION ALL SELECT page_id, 'Report ' || page_id || ' on things' FROM pages WHERE page_id % 3 = 2""",
)
def retitle_all(spark, sf):
    """Articles by their heading, some of which have it already; PDF files by their large letters."""
    from ..sources import pdf_writer as W

    @F.pandas_udf("binary")
    def made(keys):
        return keys.map(lambda n: W.document([["filler " * 60]], W.STYLES[int(n) % 10], "", {0: f"Report {n} on things"}))

    n = F.col("page_id")
    pdfs = n % 3 == 2
    rows = A.read(spark, sf, "pages").select(
        n.alias("id"),
        F.when(n % 3 == 1, X.clean_title(X.html_title("html"))).otherwise("old").alias("title"),
        F.when(pdfs, "pdf").otherwise("article").alias("content_type"),
        F.lit("").alias("extracted_text"),
        F.encode("html", "UTF-8").alias("readable_html"),
        F.when(pdfs, made(n)).alias("pdf_data"),
    )
    return E.retitled(rows)


@C.query(
    "valid_rows",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'pdf' ELSE 'article' END AS content_type, 'ok' AS index_status FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0""",
)
def valid_rows(spark, sf):
    n = F.col("event_id")
    h = F.md5(n.cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    rows = A.read(spark, sf, "events").select(
        "event_id",
        F.when(n % 3 == 0, "no id").otherwise(uuid).alias("id"),
        F.when(n % 5 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"),
        F.lit("2024-01-01T00:00:00+02:00").alias("updated_at"),
        F.when(n % 4 == 0, "pdf").otherwise("page").alias("content_type"),
        F.when(n % 2 == 0, "odd").otherwise("ok").alias("index_status"),
    )
    return E.valid(rows).select("event_id", "content_type", "index_status")


@C.query("shown_titles", f"SELECT doc_id FROM documents WHERE length({FIRST}) > 10 AND length({FIRST}) < 80")
def shown_titles(spark, sf):
    return A.read(spark, sf, "documents").where(E.shown_title(X.first_line("text"))).select("doc_id")


@C.query("shown_tags", "SELECT lang AS tag, count(*) AS count FROM documents GROUP BY lang HAVING count(*) >= 2 UNION ALL SELECT source, count(*) FROM documents GROUP BY source HAVING count(*) >= 2")
def shown_tags(spark, sf):
    d = A.read(spark, sf, "documents")
    tags = d.select(F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    return E.shown_tags(tags)


@C.query("terminal_snippets", "SELECT conv_id, turn, chr(27) || '[1;33m' || role || chr(27) || '[0m: ' || text AS shown FROM conversations")
def terminal_snippets(spark, sf):
    c = A.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", E.highlighted(F.concat(F.lit("<mark>"), "role", F.lit("</mark>: "), "text")).alias("shown"))


@C.query("pdf_pages_by_url", "SELECT page_id, page_id % 4 <> 3 AS is_pdf FROM pages")
def pdf_pages_by_url(spark, sf):
    n = F.col("page_id")
    url = F.when(n % 4 == 0, F.concat(F.lit("http://a.org/x/"), n, F.lit(".PDF?q=1"))).otherwise(F.concat(F.lit("http://a.org/x.pdf.html?"), n))
    mime = F.when(n % 4 == 1, "application/pdf; charset=x").otherwise("text/html")
    html = F.when(n % 4 == 2, F.concat("html", F.lit('<EMBED src="x" type="application/pdf">'))).otherwise(F.col("html"))
    return A.read(spark, sf, "pages").select("page_id", E.is_pdf_page(url, mime, html).alias("is_pdf"))


@C.query("repeated_styles", "SELECT page_id, html || '<b>x</b>' || '<style>q{}</style>' AS html FROM pages")
def repeated_styles(spark, sf):
    """Pages to whose end their own style and a new one, twice, are added."""
    own = F.regexp_extract("html", r"(?s)<style>.*?</style>", 0)
    new = F.lit("<style>q{}</style>")
    return A.read(spark, sf, "pages").select("page_id", E.without_repeated_styles(F.concat("html", own, F.lit("<b>x</b>"), new, own, new)).alias("html"))


@C.query("export_envelope", "SELECT '{\"version\":1,\"exported_at\":\"2024-01-02T03:04:05Z\",\"total\":' || count(*) || ',\"with_content\":true}' AS value FROM documents")
def export_envelope(spark, sf):
    return E.exported(A.entries(spark, sf), A.content(spark, sf), F.lit("2024-01-02T03:04:05Z"))


@C.query("peers_by_name", "SELECT c_name AS name, c_custkey AS id, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS place FROM customer")
def peers_by_name(spark, sf):
    """The order is read back as places."""
    rows = A.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    ordered = E.peers(rows).select(F.monotonically_increasing_id().alias("at"), "id", "label")
    return ordered.select(F.col("label").alias("name"), "id", F.row_number().over(Window.orderBy("at")).alias("place"))


@C.query("archive_paths", "SELECT r_name AS name, CASE WHEN r_regionkey % 3 = 0 THEN '/home/' || r_name WHEN r_regionkey % 3 = 1 THEN 'x/' || r_name ELSE r_name || '.db' END AS path FROM region")
def archive_paths(spark, sf):
    rows = A.read(spark, sf, "region").orderBy("r_regionkey").collect()  # five
    names = [(r["r_name"], E.archive_path([r["r_name"], "x/" + r["r_name"], r["r_name"] + ".db"][r["r_regionkey"] % 3], "/home")) for r in rows]
    return spark.createDataFrame(names, "name string, path string")


@C.query("rows_exist", "SELECT doc_id || '|' || (doc_id % 3) AS row_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = d.doc_id % 3) AS found FROM documents d")
def rows_exist(spark, sf):
    """Rows of a bridge by their composite keys."""
    keys = A.read(spark, sf, "documents").select(F.concat_ws("|", "doc_id", F.col("doc_id") % 3).alias("row_id"))
    return E.rows_exist(A.read(spark, sf, "labels"), keys, F.concat_ws("|", "doc_id", "toxic")).withColumnRenamed("exists", "found")


@C.query("point_lookup", "SELECT doc_id AS id, lang, source AS domain FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf):
    from ..operators.saving import one

    r = one(A.entries(spark, sf), 17)
    return spark.createDataFrame([(r["id"], r["lang"], r["domain"])], "id long, lang string, domain string")


# Chunks, vectors and keywords of entries that have none.

CHUNKS = r"""RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
short AS (SELECT doc_id, t, 0 AS start, length(t) AS stop FROM d WHERE strlen(t) BETWEEN 100 AND 2000),
w AS (
  SELECT doc_id, t, 0 AS start, s AS stop FROM (SELECT doc_id, t, CASE WHEN length(t) <= 2000 THEN length(t) ELSE 1600 + coalesce(nullif(length(regexp_extract(substr(t, 1601, 401), '(?s)^(.*[.!?])\s', 1)), 0), 400) END AS s FROM d WHERE strlen(t) > 2000)
  UNION ALL
  SELECT doc_id, t, nxt, CASE WHEN nxt + 2000 >= length(t) THEN length(t) ELSE nxt + 1600 + coalesce(nullif(length(regexp_extract(substr(t, nxt + 1601, 401), '(?s)^(.*[.!?])\s', 1)), 0), 400) END
  FROM (SELECT doc_id, t, start + CASE WHEN stop > start + 400 THEN greatest(stop - start - 400, 1) ELSE 1600 END AS nxt FROM w) WHERE nxt < length(t)
), a AS (SELECT * FROM short UNION ALL SELECT * FROM w),
c AS (SELECT doc_id, start, regexp_replace(substr(t, start + 1, stop - start), '^\s+|\s+$', '', 'g') AS chunk FROM a),
k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, chunk FROM c WHERE strlen(chunk) >= 100)"""
mining.C.oracles["chunk_documents"] = f"WITH {CHUNKS} SELECT doc_id AS entry_id, chunk_index, chunk AS chunk_text FROM k"


def _held(spark, sf):
    """Entries, texts and those of the entries that have derived rows already."""
    e = A.entries(spark, sf)
    return e, A.content(spark, sf), e.where("id % 3 = 0").select(F.col("id").alias("entry_id"))


@C.query("chunk_backfill", f"WITH {CHUNKS} SELECT doc_id AS entry_id, chunk_index, chunk AS chunk_text, 64 AS size, 'hashed-words-64' AS model_version FROM k WHERE doc_id % 3 <> 0")
def chunk_backfill(spark, sf):
    found = B.missing_chunks(*_held(spark, sf), vectors.HashedWords())
    return found.select("entry_id", "chunk_index", "chunk_text", F.size("embedding").alias("size"), "model_version")


@C.query("vector_backfill", "SELECT doc_id AS entry_id, 64 AS size, true AS unit FROM documents WHERE doc_id % 3 <> 0 AND strlen(text) >= 50")
def vector_backfill(spark, sf):
    found = B.missing_vectors(*_held(spark, sf), vectors.HashedWords())
    return found.select("entry_id", F.size("embedding").alias("size"), (F.abs(vectors.norm(F.col("embedding")) - 1) < 1e-5).alias("unit"))


@C.query("keyword_backfill")
def keyword_backfill(spark, sf):
    return B.missing_keywords(*_held(spark, sf)).withColumn("score", F.round("score", 9))


@C.query(
    "keywords_replaced",
    "SELECT doc_id AS entry_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS keyword, CAST(CASE WHEN doc_id % 5 = 0 THEN 0.05 ELSE 0.5 END AS DOUBLE) AS score FROM documents "
    "UNION ALL SELECT doc_id, source, 0.25 FROM documents WHERE doc_id % 5 <> 0",
)
def keywords_replaced(spark, sf):
    d = A.read(spark, sf, "documents")
    old = d.select(F.col("doc_id").alias("entry_id"), F.explode(F.array(F.struct(F.col("lang").alias("keyword"), F.lit(0.5).alias("score")), F.struct(F.col("source").alias("keyword"), F.lit(0.25).alias("score")))).alias("k")).select("entry_id", "k.*")
    new = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("entry_id"), F.lit("new").alias("keyword"), F.lit(0.05).alias("score"))
    return B.replaced(old, new)


@C.query("keywords_of_entry", "SELECT 3 AS entry_id, w AS keyword, CAST(i AS DOUBLE) AS score FROM (SELECT unnest(['c', 'a', 'b']) AS w, unnest([1, 2, 3]) AS i)")
def keywords_of_entry(spark, sf):
    ids = A.read(spark, sf, "documents").where("doc_id < 10").select(F.col("doc_id").alias("entry_id"))
    words = F.explode(F.array(*(F.struct(F.lit(w).alias("keyword"), F.lit(s).alias("score")) for w, s in (("a", 2.0), ("b", 3.0), ("c", 1.0)))))
    return B.of_entry(ids.select("entry_id", words.alias("k")).select("entry_id", "k.*"), 3)


# The context of a question: the chunks found, their entries' titles, the budget, the prompt.

_SYSTEM = _quoted("<|im_start|>system\n" + retrieval.SYSTEM + "<|im_end|>\n<|im_start|>user\nSources:\n")
RAG_SQL = f"""WITH h AS ({mining.HYBRID_SQL}),
t AS (SELECT h.*, {FIRST} AS title, substr(text, CAST(1 + 900 * chunk_index AS BIGINT), 900) AS chunk FROM h JOIN documents ON doc_id = entry_id),
b AS (SELECT *, coalesce(sum(strlen(chunk)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t),
l AS (SELECT *, '[' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || ']' AS label FROM b WHERE used < 3000)
SELECT query_id, {_SYSTEM} || string_agg(label || ' "' || title || '"' || chr(10) || chunk || chr(10) || chr(10), '' ORDER BY rank) || 'Question: Vector ' || query_id || {_quoted("?<|im_end|>" + chr(10) + "<|im_start|>assistant" + chr(10))} AS prompt
FROM l GROUP BY query_id"""


@C.query("rag_context", RAG_SQL)
def rag_context(spark, sf):
    """Retrieval, titles, budget and prompt in one: a chunk is 900 characters of its entry's text."""
    found = mining.hybrid_retrieve(spark, sf)
    d = A.read(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), X.first_line("text").alias("title"), "text")
    rows = found.join(d, "entry_id").withColumn("chunk_text", F.substring(F.col("text"), F.lit(1) + F.col("chunk_index") * 900, F.lit(900))).drop("text")
    kept = retrieval.within_budget(rows)
    sources = F.array_sort(F.collect_list(F.struct("rank", "label", "title", F.col("chunk_text").alias("text"))))
    asked = F.concat(F.lit("Vector "), F.col("query_id").cast("string"), F.lit("?"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    return kept.groupBy("query_id").agg(sources.alias("sources")).select("query_id", retrieval.prompt(F.col("sources"), none, asked, "chatml").alias("prompt"))


@C.query(
    "topic_summaries",
    """WITH m AS (SELECT label AS topic, vec_id AS entry_id, 'V' || vec_id AS title FROM embeddings)
SELECT topic, CASE WHEN topic % 2 = 0 THEN 'name ' || topic ELSE 'V' || min(entry_id) END AS label, count(*) AS count, list_slice(list(title ORDER BY entry_id), 1, 3) AS titles
FROM m GROUP BY topic HAVING count(*) >= 2 ORDER BY count DESC, topic LIMIT 20""",
)
def topic_summaries(spark, sf):
    e = A.read(spark, sf, "embeddings")
    members = e.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("topic"))
    titles = e.select(F.col("vec_id").alias("entry_id"), F.concat(F.lit("V"), "vec_id").alias("title"))
    names = members.select("topic").distinct().select("topic", F.when(F.col("topic") % 2 == 0, F.concat(F.lit("name "), "topic")).otherwise("").alias("label"))
    return topics.summaries(members, titles, names).select("topic", "label", "count", "titles")


@C.query("topic_entries", "SELECT vec_id AS entry_id FROM embeddings WHERE label = (SELECT min(label) FROM embeddings WHERE label % 2 = 1)")
def topic_entries(spark, sf):
    """The entries of the first topic of a name that several topics share."""
    e = A.read(spark, sf, "embeddings")
    members = e.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("topic"))
    names = members.select("topic").distinct().select("topic", F.when(F.col("topic") % 2 == 0, "even").otherwise("odd").alias("label"))
    return topics.entries_of(members, names, "odd")


@C.query("migrations", "SELECT * FROM (VALUES (1, 'entries, texts, pages and tags'), (2, 'index states'), (3, 'change tracking'), (4, 'terms of the index'), (5, 'vectors and keywords'), (6, 'chunks')) m(version, description)")
def migrations(spark, sf):
    return M.applied(M.migrated(spark, {})).select("version", "description")


@C.query(
    "migrated_rows",
    f"""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 AND coalesce(text, '') = '' THEN 'failed' ELSE 'ok' END AS index_status, CASE WHEN coalesce(text, '') <> '' THEN 1 ELSE 0 END AS index_version,
2 AS logged FROM documents""",
)
def migrated_rows(spark, sf):
    """Entries of version 1 brought to the last one: states are set, every row is in the log."""
    d = A.read(spark, sf, "documents")
    tables = empty(spark)
    e = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 5 == 0, "pdf").otherwise("article").alias("content_type"))
    tables["entries"] = tables["entries"].unionByName(e, allowMissingColumns=True)
    tables["entry_content"] = tables["entry_content"].unionByName(d.select(F.col("doc_id").cast("string").alias("entry_id"), F.col("text").alias("extracted_text")), allowMissingColumns=True)
    tables["schema_version"] = spark.createDataFrame([(1, "base", None)], "version int, description string, applied_at timestamp")
    out = M.migrated(spark, tables)
    logged = out["change_log"].groupBy(F.col("row_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("logged"))
    return out["entries"].join(logged, "id").select(F.col("id").cast("long").alias("id"), "index_status", "index_version", "logged")


_COLLAPSED = r"array_to_string(list_filter(regexp_split_to_array({}, '[\s\p{{Z}}\x{{85}}]+'), lambda w: w <> ''), ' ')"
_PLAIN = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def _line(x: str) -> str:
    return _COLLAPSED.format(_PLAIN.format(x))


_ARTICLE = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
_SEPARATOR = r"[|\-–—\\/>»]"
_COUNT = "len(string_split({}, ' '))"
relational_oracles = {
    "html_main_text": f"""WITH a AS (SELECT page_id, {_line(f"regexp_replace(regexp_replace({_ARTICLE}, '</?(?:p|h1)>|<br>', ' ', 'g'), '</?b>', '', 'g')")} AS t,
{_line("regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*?)(?:</body>|$)', 1), '(?s)<!--.*?-->', '', 'g'), '</?(?:b|a)(?: [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')")} AS body FROM pages)
SELECT page_id, CASE WHEN strlen(t) > 100 THEN t WHEN strlen(body) > 100 THEN body ELSE '' END AS text FROM a""",
    "readability": f"""WITH a AS (SELECT page_id, regexp_replace({_ARTICLE}, '(?s)<h1>.*?</h1>', '', 'g') AS x, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
{_line("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS raw FROM pages),
l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(x, '</?p>|<br>'), lambda y: {_line("regexp_replace(y, '</?b>', '', 'g')")}), lambda y: y <> '') AS ls,
CASE WHEN regexp_matches(raw, ' {_SEPARATOR} ') THEN regexp_replace(raw, '(.*) {_SEPARATOR} .*', '\\1') ELSE raw END AS cut FROM a),
m AS (SELECT *, CASE WHEN cut <> raw AND {_COUNT.format('cut')} < 3 THEN trim(regexp_replace(raw, '[^|\\-–—\\\\/>»]*{_SEPARATOR}(.*)', '\\1')) ELSE cut END AS short FROM l)
SELECT page_id, CASE WHEN {_COUNT.format('short')} <= 4 AND {_COUNT.format('short')} <> {_COUNT.format('raw')} - 1 THEN raw ELSE short END AS title, '' AS byline, lang, coalesce(ls[1], '') AS excerpt,
'' AS site_name, '' AS published, array_to_string(ls, chr(10)) AS text FROM m""",
}
