"""Listing, tags, figures, URLs and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fulltext as S
from ..operators import listing as L
from ..operators import tagging as T
from ..sources import archive as A
from ..sources import html
from .registry import Catalogue
from .search import DOCS, FIRST, hit_sql, text_index

C = Catalogue()

WORDS = r"len(list_filter(regexp_split_to_array({}, '[\s\p{{Z}}\x{{85}}]+'), lambda w: w <> ''))"
ENTRIES = f"""e AS (SELECT doc_id AS id, {FIRST} AS title, CASE WHEN doc_id % 5 = 0 THEN 'pdf' ELSE 'article' END AS content_type,
  source AS domain, lang, {WORDS.format("text")} AS word_count, 1704067200 + doc_id * 60 AS created_s FROM documents)"""
TAGS = """b AS (SELECT doc_id AS entry_id, lang AS tag FROM documents UNION SELECT doc_id, 's' || right(source, 1) FROM documents
  UNION SELECT doc_id, 'quality-' || quality FROM labels UNION SELECT doc_id, 'toxic-' || toxic FROM labels)"""
ALL_TAGS = "t AS (SELECT unnest(['de','en','es','fr','s0','s1','s2','s3','s4','s5','s6','s7','s8','s9','quality-0','quality-1','toxic-0','toxic-1','unused']) AS tag)"


@C.query("list_filtered_page", f"WITH {ENTRIES} SELECT id, title, created_s FROM e WHERE content_type = 'article' AND domain = 'src3' ORDER BY title, id LIMIT 20 OFFSET 3")
def list_filtered_page(spark, sf):
    p = L.ListParams(content_type="article", domain="src3", sort="title", order="asc", limit=20, offset=3)
    return L.page(L.filtered(A.entries(spark, sf), p), p).select("id", "title", "created_s")


@C.query("list_total", f"WITH {ENTRIES} SELECT count(*) AS total FROM e WHERE content_type = 'article' AND domain = 'src3'")
def list_total(spark, sf):
    p = L.ListParams(content_type="article", domain="src3")
    return L.filtered(A.entries(spark, sf), p).agg(F.count(F.lit(1)).alias("total"))


@C.query("list_by_tag", f"WITH {ENTRIES}, {TAGS} SELECT id, domain FROM e WHERE EXISTS (SELECT 1 FROM b WHERE b.entry_id = e.id AND tag = 'toxic-1') ORDER BY created_s DESC, id LIMIT 200")
def list_by_tag(spark, sf):
    p = L.ListParams(tag="toxic-1", limit=10_000)
    return L.page(L.filtered(A.entries(spark, sf), p, A.entry_tags(spark, sf)), p).select("id", "domain")


@C.query("entry_tags_array", f"WITH {TAGS} SELECT doc_id AS id, coalesce((SELECT list_sort(list(tag)) FROM b WHERE entry_id = doc_id), []) AS tags FROM documents")
def entry_tags_array(spark, sf):
    e = A.read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return L.with_tags(e, A.entry_tags(spark, sf)).select("id", "tags")


@C.query("tag_counts", f"WITH {TAGS}, {ALL_TAGS} SELECT t.tag, count(b.entry_id) AS count FROM t LEFT JOIN b ON b.tag = t.tag GROUP BY t.tag")
def tag_counts(spark, sf):
    return T.counts(A.tags(spark), A.entry_tags(spark, sf))


BY_DOMAIN = "SELECT tag, count(*) AS count FROM b JOIN e ON e.id = b.entry_id WHERE e.domain = 'src3' GROUP BY tag"
POPULAR = "SELECT tag, count(*) AS count FROM b GROUP BY tag"


@C.query("tags_by_domain", f"WITH {ENTRIES}, {TAGS} {BY_DOMAIN} ORDER BY count DESC, tag LIMIT 5")
def tags_by_domain(spark, sf):
    return T.by_domain(A.entries(spark, sf), A.entry_tags(spark, sf), "src3", 5)


@C.query("tags_popular", f"WITH {TAGS} {POPULAR} ORDER BY count DESC, tag LIMIT 15")
def tags_popular(spark, sf):
    return T.popular(A.entry_tags(spark, sf), 15)


TITLE = "the thti"
_MATCH = " AND ".join(f"({hit_sql(p, 'title')} + {hit_sql(p, 'body')}) > 0" for p in S.parse(TITLE))
SIMILAR = f"SELECT tag, count(*) AS count FROM b JOIN d ON d.doc_id = b.entry_id WHERE {_MATCH} GROUP BY tag"


def similar_ids(spark, sf):
    return S.bm25(text_index(spark, sf), S.parse(TITLE)).select("doc_id")


@C.query("tags_similar_title", f"WITH {DOCS}, {TAGS} {SIMILAR} ORDER BY count DESC, tag LIMIT 10")
def tags_similar_title(spark, sf):
    return T.by_entries(similar_ids(spark, sf), A.entry_tags(spark, sf), 10)


@C.query(
    "tag_suggestions",
    f"""WITH {ENTRIES}, {DOCS}, {TAGS}, x1 AS ({BY_DOMAIN} ORDER BY count DESC, tag LIMIT 5),
x2 AS (SELECT * FROM ({SIMILAR} ORDER BY count DESC, tag LIMIT 10) WHERE tag NOT IN (SELECT tag FROM x1) ORDER BY count DESC, tag LIMIT 5),
x3 AS (SELECT * FROM ({POPULAR} ORDER BY count DESC, tag LIMIT 15) WHERE tag NOT IN (SELECT tag FROM x1 UNION SELECT tag FROM x2) ORDER BY count DESC, tag LIMIT 5)
SELECT 'domain' AS kind, tag, count FROM x1 UNION ALL SELECT 'similar', tag, count FROM x2 UNION ALL SELECT 'popular', tag, count FROM x3""",
)
def tag_suggestions(spark, sf):
    bridge = A.entry_tags(spark, sf)
    return T.suggestions(
        T.by_domain(A.entries(spark, sf), bridge, "src3", 5), T.by_entries(similar_ids(spark, sf), bridge, 10), T.popular(bridge, 15)
    )


@C.query(
    "archive_stats",
    f"""WITH {ENTRIES} SELECT count(*) AS total, count(*) FILTER (content_type = 'pdf') AS pdfs, count(*) FILTER (content_type = 'article') AS articles,
count(DISTINCT domain) AS domains, count(*) FILTER (created_s >= 1704067200 + 10 * 86400 - 7 * 86400) AS recent FROM e""",
)
def archive_stats(spark, sf):
    return T.stats(A.entries(spark, sf), F.lit(1704067200 + 10 * 86400), F.col("created_s"))


@C.query("recent_count", "SELECT count(*) AS recent FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def recent_count(spark, sf):
    e = A.read(spark, sf, "events")
    last = e.agg(F.max("ts").alias("t")).first()["t"]
    if last is None:
        return e.agg(F.count(F.lit(1)).alias("recent"))
    return e.where(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).agg(F.count(F.lit(1)).alias("recent"))


@C.query("backfill_missing", "SELECT doc_id AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def backfill_missing(spark, sf):
    e = A.read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return L.missing(e, A.read(spark, sf, "labels"), "doc_id")


@C.query(
    "reprocess_candidates",
    """SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 5 = 0
AND (coalesce(text, '') = '' OR coalesce(CASE WHEN quality = 0 THEN 'failed' END, 'ok') IN ('failed', 'pending') OR coalesce(quality, 0) < 1)""",
)
def reprocess_candidates(spark, sf):
    d = A.read(spark, sf, "documents").join(A.read(spark, sf, "labels"), "doc_id", "left")
    rows = d.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 5 == 0, "pdf").otherwise("article").alias("content_type"),
        F.lit(b"x").alias("pdf_data"),
        F.col("text").alias("extracted_text"),
        F.when(F.col("quality") == 0, "failed").alias("index_status"),
        F.col("quality").alias("index_version"),
    )
    return L.to_reprocess(rows, 1).select("id")


@C.query(
    "transfer_dedupe",
    """WITH s AS (SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE regexp_replace(url, '[?#].*$', '') END AS url FROM pages),
t AS (SELECT * FROM s WHERE id % 3 = 0), n AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM t) AND (url IS NULL OR url NOT IN (SELECT url FROM t WHERE url IS NOT NULL)))
SELECT id, url FROM n WHERE url IS NULL UNION ALL SELECT min(id), url FROM n WHERE url IS NOT NULL GROUP BY url""",
)
def transfer_dedupe(spark, sf):
    url = F.when(F.col("page_id") % 7 == 0, None).otherwise(F.regexp_replace("url", "[?#].*$", ""))
    s = A.read(spark, sf, "pages").select(F.col("page_id").alias("id"), url.alias("url"))
    return L.transferred(s, s.where("id % 3 = 0"))


@C.query("urls_known", "SELECT url, page_id AS id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 10 = 1)")
def urls_known(spark, sf):
    p = A.read(spark, sf, "pages").select("url", F.col("page_id").alias("id"))
    return L.existing_urls(p, p.where("id % 10 = 1"))


@C.query("entries_by_ids", f"WITH {ENTRIES} SELECT id, domain, created_s FROM e WHERE id IN (SELECT page_id FROM pages WHERE page_id % 4 = 0)")
def entries_by_ids(spark, sf):
    ids = A.read(spark, sf, "pages").where("page_id % 4 = 0").select(F.col("page_id").alias("id"))
    return L.by_ids(A.entries(spark, sf), ids).select("id", "domain", "created_s")


@C.query("word_counts", f"SELECT doc_id, CAST({WORDS.format('text')} AS BIGINT) AS word_count, CASE WHEN coalesce(text, '') = '' THEN 'failed' ELSE 'ok' END AS index_status FROM documents")
def word_counts(spark, sf):
    return A.read(spark, sf, "documents").select("doc_id", X.word_count("text").alias("word_count"), L.index_status(F.col("text")).alias("index_status"))


@C.query(
    "migrate_backfill",
    "SELECT doc_id, CASE WHEN coalesce(text, '') <> '' THEN 1 ELSE 0 END AS index_version, CASE WHEN doc_id % 5 = 0 AND coalesce(text, '') = '' THEN 'failed' ELSE 'ok' END AS index_status FROM documents",
)
def migrate_backfill(spark, sf):
    empty = F.coalesce("text", F.lit("")) == ""
    return A.read(spark, sf, "documents").select(
        "doc_id", F.when(empty, 0).otherwise(1).alias("index_version"), F.when((F.col("doc_id") % 5 == 0) & empty, "failed").otherwise("ok").alias("index_status")
    )


@C.query(
    "url_parts",
    r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) IN ('') OR regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) LIKE '%/' THEN 'Untitled PDF'
ELSE regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1) END AS file FROM pages""",
)
def url_parts(spark, sf):
    return A.read(spark, sf, "pages").select("page_id", X.host("url").alias("host"), X.file_name("url").alias("file"))


TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"


def _cut(x: str, most: int) -> str:
    """Truncation to bytes at a blank beyond the middle, else to characters."""
    whole = f"left({x}, list_max(list_filter(range(0, {most + 1}), lambda k: strlen(left({x}, k)) <= {most})))"
    before = f"regexp_extract({whole}, '(?s)^(.*) ', 1)"
    return f"CASE WHEN strlen({x}) <= {most} THEN {x} WHEN contains({whole}, ' ') AND strlen({before}) > {most // 2} THEN {before} ELSE left({x}, {most}) END"


_JUNK_H = "', '".join(X.JUNK_HEADINGS)


def _heading(tag: str) -> str:
    t = TRIM.format(f"replace(regexp_replace(regexp_extract(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*(>|$)', '', 'g'), '>', '')")
    return f"CASE WHEN strlen({t}) >= 5 AND lower({t}) NOT IN ('{_JUNK_H}') AND NOT (starts_with(lower({t}), '1.') AND strlen({t}) < 20) THEN {_cut(t, 150)} END"


@C.query("title_from_html", f"SELECT page_id, coalesce({_heading('h1')}, {_heading('h2')}, {_heading('h3')}) AS title FROM pages")
def title_from_html(spark, sf):
    return A.read(spark, sf, "pages").select("page_id", X.html_title("html").alias("title"))


_STARTS = "|".join(s.replace(".", "[.]") for s in X.JUNK_STARTS)
_BODY = "|".join(X.BODY_STARTS)


@C.query(
    "title_from_text",
    rf"""WITH l AS (SELECT doc_id, unnest(generate_series(0, least(len(string_split_regex(text, '\r?\n')), 30) - 1)) AS pos, string_split_regex(text, '\r?\n') AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
t AS (SELECT doc_id, pos, {TRIM.format('ls[pos + 1]')} AS line FROM l),
w AS (SELECT *, strlen(line) AS size, list_filter(regexp_split_to_array(line, '[\s\p{{Z}}\x{{85}}]+'), lambda x: x <> '') AS words FROM t),
s AS (SELECT doc_id, pos, line, greatest(25 - pos, 0) + CASE WHEN size BETWEEN 30 AND 120 THEN 10 WHEN size < 30 THEN 3 ELSE 0 END
  + CASE WHEN line LIKE '%.' THEN 0 ELSE 5 END - CASE WHEN regexp_matches(lower(line), '^({_BODY})') THEN 15 ELSE 0 END
  - CASE WHEN size < 30 AND line = upper(line) AND NOT regexp_matches(line, '\p{{Ll}}') THEN 10 ELSE 0 END
  + CASE WHEN len(words) >= 3 AND len(list_filter(words, lambda x: regexp_matches(x, '^\p{{Lu}}'))) > len(words) // 2 THEN 5 ELSE 0 END AS score
  FROM w WHERE size BETWEEN 10 AND 200 AND NOT (regexp_matches(lower(line), '^({_STARTS})') OR (starts_with(lower(line), 'page ') AND size < 15)
  OR (contains(line, '@') AND contains(line, '.')) OR starts_with(lower(line), 'subscriber access') OR regexp_matches(line, '^[0-9. -]*$'))),
b AS (SELECT doc_id, line FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1)
SELECT d.doc_id, {_cut('b.line', 120)} AS title FROM documents d LEFT JOIN b USING (doc_id)""",
)
def title_from_text(spark, sf):
    return A.read(spark, sf, "documents").select("doc_id", X.text_title("text").alias("title"))


def _clean_sql(x: str) -> str:
    """One separator's step, for titles of at most one separator of that kind."""
    t = rf"array_to_string(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''), ' ')"
    for sep in (" - ", " | "):
        e = sep.replace("|", r"\|")
        before, after = f"regexp_extract({t}, '^(.*){e}', 1)", f"regexp_extract({t}, '^.*{e}(.*)$', 1)"
        t = (
            f"(CASE WHEN contains({t}, '{sep}') AND strlen({before}) > strlen({after}) AND strlen({before}) >= 15 THEN {before} "
            f"WHEN contains({t}, '{sep}') AND strlen({after}) > strlen({before}) AND strlen({after}) >= 15 THEN {after} ELSE {t} END)"
        )
    return t


_RAW = "regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"


@C.query("clean_titles", f"SELECT page_id, {_clean_sql(_RAW)} AS title FROM pages")
def clean_titles(spark, sf):
    return A.read(spark, sf, "pages").select("page_id", X.clean_title(F.coalesce(X.first_tag("html", "title"), F.lit(""))).alias("title"))


@C.query(
    "generic_titles",
    f"WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' PDF ' WHEN 1 THEN 'untitled pdf' WHEN 2 THEN 'abc' ELSE {_RAW} END AS title FROM pages) "
    "SELECT page_id, lower(trim(title)) IN ('', 'pdf', 'untitled', 'untitled pdf', 'document', 'download') OR strlen(trim(title)) <= 3 AS generic FROM t",
)
def generic_titles(spark, sf):
    n = F.col("page_id") % 5
    title = F.when(n == 0, " PDF ").when(n == 1, "untitled pdf").when(n == 2, "abc").otherwise(F.coalesce(X.first_tag("html", "title"), F.lit("")))
    return A.read(spark, sf, "pages").select("page_id", X.is_generic_title(title).alias("generic"))


@C.query("base64_roundtrip", "SELECT page_id, base64(encode(html)) AS b64, strlen(html) AS bytes FROM pages")
def base64_roundtrip(spark, sf):
    """The last column is read back from the encoded one; bad input would be null, not an error."""
    b64 = F.regexp_replace(F.base64(F.encode("html", "UTF-8")), "[\\r\\n]", "")
    return A.read(spark, sf, "pages").select("page_id", b64.alias("b64"), F.octet_length(F.try_to_binary(b64, F.lit("base64"))).cast("long").alias("bytes"))


@C.query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return A.read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@C.query("citations", "SELECT conv_id, turn, list_transform(regexp_extract_all(text || ' [3] and [12]', '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)) AS cited FROM conversations")
def citations(spark, sf):
    return A.read(spark, sf, "conversations").select("conv_id", "turn", X.citations(F.concat("text", F.lit(" [3] and [12]"))).alias("cited"))


@C.query("size_labels", "SELECT p_partkey, CASE WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1e9) ELSE CAST(n // 1000000 AS VARCHAR) || ' MB' END AS label FROM (SELECT p_partkey, CAST(floor(p_retailprice * 1000000) AS BIGINT) AS n FROM part)")
def size_labels(spark, sf):
    n = F.floor(F.col("p_retailprice") * 1_000_000)
    return A.read(spark, sf, "part").select("p_partkey", X.size_label(n).alias("label"))


@C.query(
    "relative_dates",
    """WITH o AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-06-02') AS n, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n < 7 THEN n || 'd ago' WHEN n < 30 THEN (n // 7) || 'w ago'
  WHEN year(day) = 1997 THEN strftime(day, '%b %-d') ELSE strftime(day, '%b %-d, %Y') END AS label FROM o""",
)
def relative_dates(spark, sf):
    today, day = F.to_date(F.lit("1997-06-02")), F.to_date("o_orderdate")
    return A.read(spark, sf, "orders").select("o_orderkey", X.relative_date(day, today).alias("label"))


@C.query("tag_edit", f"WITH {TAGS}, g AS (SELECT entry_id, list_sort(list(tag)) AS tags FROM b GROUP BY entry_id) SELECT entry_id, list_filter(CASE WHEN list_contains(tags, 'new') THEN tags ELSE tags || ['new'] END, lambda t: t <> 'en') AS tags FROM g")
def tag_edit(spark, sf):
    e = A.read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return L.with_tags(e, A.entry_tags(spark, sf)).select(F.col("id").alias("entry_id"), L.edit_tags(F.col("tags"), [" New "], ["EN"]).alias("tags"))


@C.query("export_json", "SELECT doc_id AS id, strlen(text) AS bytes FROM documents")
def export_json(spark, sf):
    """Read back from the exported lines."""
    e = A.read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    lines = L.export_rows(e, A.content(spark, sf))
    row = F.from_json("value", "id long, extracted_text string")
    return lines.select(row.alias("r")).select("r.id", F.octet_length("r.extracted_text").cast("long").alias("bytes"))


@C.query("filter_category_rollup", "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment")
def filter_category_rollup(spark, sf):
    n = F.broadcast(A.read(spark, sf, "nation"))  # 25 rows at every scale
    c = A.read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@C.query("html_main_text")
def html_main_text(spark, sf):
    return html.main_texts(A.read(spark, sf, "pages"))


@C.query("readability")
def readability(spark, sf):
    return html.articles(A.read(spark, sf, "pages")).drop("content")
