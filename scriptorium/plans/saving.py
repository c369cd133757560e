"""Saving, changing and deleting entries, their log, and merging it into a replica."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import changes as H
from ..operators import saving as S
from ..sources import archive as A
from .registry import Catalogue
from .relational import WORDS

C = Catalogue()

FIRST, SECOND, THIRD, LAST = (S.Operation(1_704_067_200_000 + 1000 * n, 0, "site-a", n) for n in (1, 2, 3, 4))
TRACKED = ("entries", "entry_content", "pdf_pages", "tags", "entry_tags", "change_log", "tombstones")


def empty(spark):
    return {t: spark.createDataFrame([], A.SCHEMAS[t]) for t in TRACKED}


def requests(spark, sf):
    """A request for every document; some share a URL, some have none, a fifth are PDF files, half of these with pages."""
    d = A.read(spark, sf, "documents")
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    page = lambda i: F.struct(F.lit(i).alias("page_num"), F.substring(text, 100 * i - 99, 100).alias("text"))
    none = F.lit(None).cast("binary")
    return d.select(
        n.alias("request"),
        F.when(n % 7 != 0, F.concat(F.lit("http://src"), n % 5, F.lit(".Example.org/a/"), n % 45)).alias("url"),
        F.concat(F.lit("T"), n).alias("title"),
        F.when(n % 5 == 0, "pdf").otherwise("article").alias("content_type"),
        F.when(n % 10 == 0, "").otherwise(text).alias("extracted_text"),
        none.alias("snapshot_html"),
        none.alias("readable_html"),
        none.alias("pdf_data"),
        F.when(n % 10 == 0, F.array(page(1), page(2))).alias("pages"),
        F.array(F.col("lang"), F.concat(F.lit("s"), F.right("source", F.lit(1)))).alias("tags"),
        F.lit("cli").alias("source"),
    )


def filled(spark, sf):
    """Even requests are saved first, then odd ones. Written once an application, like any archive."""
    return dict(_filled(spark.sparkContext.applicationId, sf))


@lru_cache(4)
def _filled(application, sf):
    spark = SparkSession.getActiveSession()
    r = requests(spark, sf)
    before = S.stored(empty(spark))
    half = S.stored(S.saved(before, r.where("request % 2 = 0"), FIRST), before)
    return S.stored(S.saved(half, r.where("request % 2 = 1"), SECOND), half)


R = f"""r AS (SELECT doc_id AS n, CASE WHEN doc_id % 7 <> 0 THEN 'http://src' || (doc_id % 5) || '.Example.org/a/' || (doc_id % 45) END AS url, source, lang,
  CASE WHEN doc_id % 5 = 0 THEN 'pdf' ELSE 'article' END AS content_type, coalesce(text, '') AS body FROM documents),
s AS (SELECT *, 1 + n % 2 AS version, CASE WHEN n % 10 = 0 THEN substr(body, 1, 100) || chr(10) || chr(10) || substr(body, 101, 100) ELSE body END AS text FROM r
  QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY n % 2, n) = 1),
e AS (SELECT *, 'T' || n AS title, CASE WHEN url IS NOT NULL THEN 'src' || (n % 5) || '.example.org' END AS domain, CAST({WORDS.format("text")} AS BIGINT) AS word_count,
  CASE WHEN content_type = 'pdf' THEN CASE WHEN n % 10 = 0 THEN 2 ELSE 0 END END AS page_count FROM s),
g AS (SELECT n, lang AS tag FROM s UNION SELECT n, 's' || right(source, 1) FROM s)"""


@C.query(
    "save_entries",
    f"""WITH {R} SELECT title, url, domain, content_type, word_count, CAST(page_count AS BIGINT) AS page_count,
CASE WHEN text = '' AND coalesce(page_count, 0) = 0 THEN 'failed' ELSE 'ok' END AS index_status, 1704067200 + version AS created_s, 'cli' AS saved_by FROM e""",
)
def save_entries(spark, sf):
    e = filled(spark, sf)["entries"]
    return e.select("title", "url", "domain", "content_type", "word_count", "page_count", "index_status", F.unix_seconds("created_at").alias("created_s"), "saved_by")


@C.query("save_pages", f"WITH {R} SELECT title, i AS page_num, substr(body, CAST(100 * i - 99 AS BIGINT), 100) AS text FROM e, (VALUES (1), (2)) p(i) WHERE n % 10 = 0")
def save_pages(spark, sf):
    a = filled(spark, sf)
    return a["pdf_pages"].join(a["entries"].select(F.col("id").alias("entry_id"), "title"), "entry_id").select("title", "page_num", "text")


@C.query("save_tags", f"WITH {R} SELECT title, list_sort(list(tag)) AS tags FROM e JOIN g USING (n) GROUP BY title")
def save_tags(spark, sf):
    return _tags(filled(spark, sf)).select("title", "tags")


def _tags(a):
    """Entries with the names of their tags."""
    names = a["entry_tags"].join(a["tags"].withColumnRenamed("id", "tag_id"), "tag_id").groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("tags"))
    return a["entries"].join(names, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


@C.query(
    "save_existing",
    f"""WITH {R} SELECT r.n AS request, (SELECT s.n FROM s WHERE s.url = r.url) AS holder FROM r WHERE n NOT IN (SELECT n FROM s) AND n % 2 = 1
AND (SELECT s.n FROM s WHERE s.url = r.url) % 2 = 0""",
)
def save_existing(spark, sf):
    """Odd requests whose URL an even one has: they are given the entry that is there."""
    r = requests(spark, sf)
    a = S.saved(empty(spark), r.where("request % 2 = 0"), FIRST)
    found = S.resolved(a, r.where("request % 2 = 1")).where("existing is not null").select("request", F.col("existing").alias("id"))
    return found.join(a["entries"], "id").select("request", F.substring("title", 2, 20).cast("long").alias("holder"))


def changed(spark, sf):
    """Entries edited by the number in their title, then texts replaced, then some deleted."""
    return dict(_changed(spark.sparkContext.applicationId, sf))


@lru_cache(4)
def _changed(application, sf):
    spark = SparkSession.getActiveSession()
    first = filled(spark, sf)
    rows = first["entries"].select("id", F.substring("title", 2, 20).cast("long").alias("n"))
    tags = F.array(F.lit("edited"), F.lit("en"))
    edits = rows.where("n % 4 = 1").select("id", F.when(F.col("n") % 8 == 1, F.concat(F.lit("New "), F.col("n"))).alias("title"), F.when(F.col("n") % 12 == 1, tags).alias("tags"))
    unknown = spark.createDataFrame([("nobody", "x", None)], "id string, title string, tags array<string>")
    second = S.stored(S.updated(first, edits.unionByName(unknown), THIRD), first)
    none = F.lit(None).cast("binary")
    texts = rows.where("n % 6 = 2").select("id", F.concat(F.lit("one two "), F.col("n")).alias("extracted_text"), none.alias("snapshot_html"), F.encode(F.lit("<p>"), "UTF-8").alias("readable_html"))
    third = S.stored(S.content_updated(second, texts, THIRD), second)
    return S.stored(S.deleted(third, rows.where("n % 9 = 4").select("id").unionByName(unknown.select("id")), LAST), third)


U = f"""{R}, u AS (SELECT *, n % 4 = 1 AS edited, n % 8 = 1 AS renamed, n % 12 = 1 AS retagged, n % 6 = 2 AS rewritten, n % 9 = 4 AS gone FROM e)"""


@C.query(
    "update_entries",
    f"""WITH {U} SELECT n, CASE WHEN renamed THEN 'New ' || n ELSE title END AS title, CASE WHEN rewritten THEN 3 ELSE word_count END AS word_count,
CASE WHEN edited OR rewritten THEN 1704067203 ELSE 1704067200 + version END AS updated_s, CASE WHEN retagged THEN ['edited', 'en'] ELSE (SELECT list_sort(list(tag)) FROM g WHERE g.n = u.n) END AS tags FROM u WHERE NOT gone""",
)
def update_entries(spark, sf):
    out = _tags(changed(spark, sf))
    n = F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("n")
    return out.select(n, "title", "word_count", F.unix_seconds("updated_at").alias("updated_s"), "tags")


@C.query(
    "delete_entries",
    f"WITH {U} SELECT 'entries' AS tbl, count(*) AS kept FROM u WHERE NOT gone UNION ALL SELECT 'entry_content', count(*) FROM u WHERE NOT gone "
    f"UNION ALL SELECT 'pdf_pages', 2 * count(*) FROM u WHERE NOT gone AND n % 10 = 0 UNION ALL SELECT 'tombstones', count(*) FROM u WHERE gone",
)
def delete_entries(spark, sf):
    a = changed(spark, sf)
    parts = [a[t].agg(F.count(F.lit(1)).alias("kept")).select(F.lit(t).alias("tbl"), "kept") for t in ("entries", "entry_content", "pdf_pages", "tombstones")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@C.query(
    "change_log_counts",
    f"""WITH {U}, t AS (SELECT min(version) AS version FROM g JOIN s USING (n) GROUP BY tag),
l AS (SELECT 'entries' AS tbl, '__row__' AS col, version FROM u UNION ALL SELECT 'entry_content', '__row__', version FROM u
UNION ALL SELECT 'pdf_pages', '__row__', version FROM u, range(2) WHERE n % 10 = 0 UNION ALL SELECT 'tags', '__row__', version FROM t
UNION ALL SELECT 'entry_tags', '__row__', version FROM g JOIN s USING (n) UNION ALL SELECT 'entries', 'title', 3 FROM u WHERE edited AND renamed
UNION ALL SELECT 'entries', 'updated_at', 3 FROM u WHERE edited UNION ALL SELECT 'tags', '__row__', 3 FROM (SELECT 1 FROM u WHERE retagged LIMIT 1)
UNION ALL SELECT 'entry_tags', '__row__', 3 FROM u, (VALUES ('edited'), ('en')) w(tag) WHERE retagged AND tag NOT IN (SELECT tag FROM g WHERE g.n = u.n)
UNION ALL SELECT 'entry_tags', '__tombstone__', 3 FROM u JOIN g USING (n) WHERE retagged AND tag NOT IN ('edited', 'en')
UNION ALL SELECT 'entry_content', unnest(['extracted_text', 'readable_html']), 3 FROM u WHERE rewritten
UNION ALL SELECT 'entries', unnest(['word_count', 'updated_at']), 3 FROM u WHERE rewritten
UNION ALL SELECT unnest(['entries', 'entry_content']), '__tombstone__', 4 FROM u WHERE gone UNION ALL SELECT 'pdf_pages', '__tombstone__', 4 FROM u, range(2) WHERE gone AND n % 10 = 0
UNION ALL SELECT 'entry_tags', '__tombstone__', 4 FROM u JOIN g USING (n) WHERE gone AND NOT retagged UNION ALL SELECT 'entry_tags', '__tombstone__', 4 FROM u, range(2) WHERE gone AND retagged)
SELECT tbl, col, CAST(version AS BIGINT) AS db_version, count(*) AS n FROM l GROUP BY ALL""",
)
def change_log_counts(spark, sf):
    return changed(spark, sf)["change_log"].groupBy("tbl", "col", "db_version").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "export_changes",
    f"""WITH {U} SELECT n, unnest(['title', 'word_count', 'domain']) AS col, unnest([CASE WHEN renamed THEN 'New ' || n ELSE title END, CAST(CASE WHEN rewritten THEN 3 ELSE word_count END AS VARCHAR), domain]) AS val
FROM u WHERE NOT gone AND version = 2""",
)
def export_changes(spark, sf):
    """Whole rows since the first version, spelled out with what the entries hold now."""
    a = changed(spark, sf)
    cells, _ = S.exported(a, 1)
    whole = cells.where("tbl = 'entries' and db_version = 2 and col in ('title', 'word_count', 'domain')")
    n = F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("n")
    return whole.join(a["entries"].select(F.col("id").alias("row_id"), n), "row_id").select("n", "col", "val")


@C.query("seed_log", f"WITH {R} SELECT 'entries' AS tbl, count(*) AS n FROM e UNION ALL SELECT 'entry_content', count(*) FROM e UNION ALL SELECT 'pdf_pages', 2 * count(*) FROM e WHERE n % 10 = 0 UNION ALL SELECT 'tags', count(DISTINCT tag) FROM g UNION ALL SELECT 'entry_tags', count(*) FROM g")
def seed_log(spark, sf):
    return S.seeded(filled(spark, sf), THIRD).groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))


def merged(spark, sf):
    """A replica that has the first two versions takes over the rest."""
    replica, source = filled(spark, sf), changed(spark, sf)
    cells, graves = S.exported(source, 2)
    return H.applied(replica, *S.stored({"cells": cells, "graves": graves}).values(), 9)


@C.query(
    "apply_changes",
    f"""WITH {U} SELECT n, CASE WHEN renamed THEN 'New ' || n ELSE title END AS title, CASE WHEN rewritten THEN 3 ELSE word_count END AS word_count,
CASE WHEN retagged THEN ['edited', 'en'] ELSE (SELECT list_sort(list(tag)) FROM g WHERE g.n = u.n) END AS tags, CASE WHEN rewritten THEN 'one two ' || n ELSE text END AS text FROM u WHERE NOT gone""",
)
def apply_changes(spark, sf):
    a, _ = merged(spark, sf)
    n = F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("n")
    out = _tags(a).join(a["entry_content"].select(F.col("entry_id").alias("id"), F.col("extracted_text").alias("text")), "id")
    return out.select(n, "title", "word_count", "tags", "text")


@C.query("reindex_touched", f"WITH {U} SELECT n FROM u WHERE (edited OR rewritten) AND NOT gone")
def reindex_touched(spark, sf):
    source = changed(spark, sf)
    cells, _ = S.exported(source, 2)
    n = F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("n")
    return H.touched(cells).join(source["entries"].select(F.col("id").alias("doc_id"), n), "doc_id").select("n")


@C.query(
    "sql_values",
    """SELECT c_custkey, '{"t":"Integer","v":' || c_custkey || '}' AS key_json, '{"t":"Text","v":"' || c_name || '"}' AS name_json, '{"t":"Blob","v":"' || base64(encode(c_name)) || '"}' AS blob_json,
CASE WHEN c_custkey % 3 = 0 THEN '{"t":"Null"}' ELSE '{"t":"Integer","v":' || c_nationkey || '}' END AS nation_json, c_acctbal, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS nation FROM customer""",
)
def sql_values(spark, sf):
    """Values as JSON with their kinds, and back."""
    c = A.read(spark, sf, "customer")
    nation = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("bigint"))
    wire = c.select(
        "c_custkey",
        H.to_wire(F.col("c_custkey").cast("bigint"), "bigint").alias("key_json"),
        H.to_wire(F.col("c_name"), "string").alias("name_json"),
        H.to_wire(F.encode("c_name", "UTF-8"), "binary").alias("blob_json"),
        H.to_wire(nation, "bigint").alias("nation_json"),
        H.to_wire(F.col("c_acctbal").cast("double"), "double").alias("balance_json"),
    )
    back = F.decode(H.from_wire(F.col("blob_json"), "binary"), "UTF-8")
    return wire.select("c_custkey", "key_json", "name_json", "blob_json", "nation_json", H.from_wire(F.col("balance_json"), "double").alias("c_acctbal"), back.alias("name"), H.from_wire(F.col("nation_json"), "bigint").alias("nation"))


@C.query(
    "save_from_json",
    """SELECT doc_id AS n, 'U' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'article' END AS content_type, CASE WHEN doc_id % 4 = 1 THEN 'bad Base64 in snapshot_html' END AS error,
CASE WHEN doc_id % 4 = 0 THEN lang END AS html, strlen(coalesce(text, '')) AS bytes FROM documents""",
)
def save_from_json(spark, sf):
    d = A.read(spark, sf, "documents")
    n = F.col("doc_id")
    body = F.struct(
        F.concat(F.lit("U"), n).alias("url"),
        F.lit("").alias("title"),
        F.when(n % 3 == 0, "pdf").otherwise("page").alias("content_type"),
        F.col("text").alias("extracted_text"),
        F.when(n % 4 == 0, F.base64(F.encode("lang", "UTF-8"))).when(n % 4 == 1, "%%%").alias("snapshot_html"),
    )
    rows = S.from_json(d.select(F.to_json(body).alias("value")), strict=True)
    return rows.select(F.substring("url", 2, 20).cast("long").alias("n"), "title", "content_type", "error", F.decode("snapshot_html", "UTF-8").alias("html"), F.octet_length("extracted_text").cast("long").alias("bytes"))


@C.query("sync_state", "SELECT 'site-x' AS site_id, 42 AS db_version, max(event_id) AS wall, 0 AS counter FROM events")
def sync_state(spark, sf):
    """State read from its rows, advanced and written back."""
    top = A.read(spark, sf, "events").agg(F.max("event_id").cast("string").alias("value"))
    meta = spark.createDataFrame([("site_id", "site-x"), ("db_version", "41"), ("hlc_counter", "none"), ("other", "1")], "key string, value string")
    state = H.SyncState.loaded(meta.union(top.select(F.lit("hlc_wall").alias("key"), "value")), "new")
    state.next_version()
    back = H.SyncState.loaded(state.rows(spark), "new")
    return spark.createDataFrame([(back.site_id, back.db_version, back.wall_ms, back.counter)], "site_id string, db_version int, wall long, counter int")
