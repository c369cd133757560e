"""Saving, changing and deleting entries, set by set, with the change log that replicas merge.

An archive is a dict of DataFrames by table name (``sources.archive.SCHEMAS``). Each function takes one, applies a set of
requests to it and returns a new one; nothing is written. Every operation has one clock (``hlc_ts, hlc_counter,
site_id``) and one version, which its rows of the change log carry.

Ids are made from the operation and the row's number in it (SHA-256 in the form of a UUID), so a job that runs again
makes the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.archive import CONTENT_TYPES, SAVE_SOURCES, SCHEMAS
from ..session import scratch
from .changes import ROW, row_key

Tables = dict[str, DataFrame]
INDEX_VERSION = 1
TOMBSTONE = "__tombstone__"
#: Tables whose rows go with their entry, and the column that names it.
OWNED = {"entry_content": "entry_id", "pdf_pages": "entry_id", "entry_tags": "entry_id", "entry_embeddings": "entry_id", "entry_keywords": "entry_id", "entry_chunks": "entry_id"}
REQUEST = (
    "request long, url string, title string, content_type string, extracted_text string, snapshot_html binary, "
    "readable_html binary, pdf_data binary, pages array<struct<page_num:int,text:string>>, tags array<string>, source string"
)


@dataclass(frozen=True)
class Operation:
    """When, where and as which version something is written."""

    hlc_ts: int
    hlc_counter: int
    site_id: str
    db_version: int

    @property
    def time(self) -> Column:
        return F.timestamp_millis(F.lit(self.hlc_ts))

    def stamped(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"hlc_ts": F.lit(self.hlc_ts).cast("long"), "hlc_counter": F.lit(self.hlc_counter).cast("long"), "site_id": F.lit(self.site_id), "db_version": F.lit(self.db_version).cast("long")})

    def new_id(self, *parts: Column | str) -> Column:
        named = [F.lit(self.site_id), F.lit(str(self.db_version)), *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)]
        h = F.sha2(F.concat_ws("|", *named), 256)
        cut = lambda a, n: F.substring(h, a, n)
        return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def from_json(lines: DataFrame, value_col: str = "value", strict: bool = False) -> DataFrame:
    """Requests out of JSON: binary fields are Base64, an unknown content type is an article, an unknown source the API.

    Bad Base64 gives null; with ``strict`` the row has ``error`` instead. The title is the URL or ``Untitled`` if empty.
    """
    schema = "url string, title string, content_type string, extracted_text string, snapshot_html string, readable_html string, pdf_data string, tags array<string>, source string"
    rows = lines.select(F.monotonically_increasing_id().alias("request"), F.from_json(value_col, schema).alias("j")).select("request", "j.*")
    blobs = ("snapshot_html", "readable_html", "pdf_data")
    decoded = {b: F.try_to_binary(F.col(b), F.lit("base64")) for b in blobs}
    bad = [F.when(F.col(b).isNotNull() & decoded[b].isNull(), F.lit(f"bad Base64 in {b}")) for b in blobs]
    out = rows.withColumn("error", F.coalesce(*bad) if strict else F.lit(None).cast("string")).withColumns(decoded)
    known = lambda c, names, other: F.when(F.col(c).isin(*names), F.col(c)).otherwise(other)
    return out.withColumns(
        {
            "content_type": known("content_type", CONTENT_TYPES, "article"),
            "source": known("source", SAVE_SOURCES, "api"),
            "title": F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.coalesce(F.nullif("url", F.lit("")), F.lit("Untitled"))),
            "extracted_text": F.coalesce("extracted_text", F.lit("")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "pages": F.lit(None).cast("array<struct<page_num:int,text:string>>"),
        }
    )


def resolved(archive: Tables, requests: DataFrame) -> DataFrame:
    """``requests`` with ``existing``: the id of the entry, or the least request, that already has the URL (else null).

    Of requests with one URL the least is saved, the others find it.
    """
    known = archive["entries"].where(F.col("url").isNotNull()).groupBy("url").agg(F.min("id").alias("known"))
    first = requests.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("request").alias("first"))
    rows = requests.join(known, "url", "left").join(first, "url", "left")
    return rows.withColumn("existing", F.coalesce("known", F.when(F.col("first") < F.col("request"), F.concat(F.lit("request "), F.col("first"))))).drop("known", "first")


def saved(archive: Tables, requests: DataFrame, op: Operation) -> Tables:
    """The archive with an entry for every request whose URL it doesn't hold yet.

    Articles without text, and PDF files without text and pages, have failed. A PDF's text is that of its pages unless
    the request brings one. Tags are made if there are none of that name.
    """
    new = resolved(archive, requests).where("existing is null").drop("existing").withColumn("id", op.new_id("entry", F.col("request")))
    pages = F.coalesce("pages", F.array().cast("array<struct<page_num:int,text:string>>"))
    is_pdf = F.col("content_type") == "pdf"
    joined = F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n")
    text = F.when(is_pdf & (F.coalesce("extracted_text", F.lit("")) == ""), joined).otherwise(F.coalesce("extracted_text", F.lit("")))
    new = new.withColumn("extracted_text", text)
    failed = (F.col("extracted_text") == "") & (~is_pdf | (F.size(pages) == 0))
    entries = new.select(
        "id", "url", "title", "content_type", F.lit("read").alias("status"), X.host("url").alias("domain"),
        X.word_count("extracted_text").alias("word_count"), F.when(is_pdf, F.size(pages).cast("long")).alias("page_count"),
        op.time.alias("created_at"), op.time.alias("updated_at"), F.col("source").alias("saved_by"),
        F.when(failed, "failed").otherwise("ok").alias("index_status"), F.lit(INDEX_VERSION).alias("index_version"),
    )
    blob = lambda c: F.when(~is_pdf, F.col(c)).alias(c)
    content = new.select(F.col("id").alias("entry_id"), "extracted_text", blob("snapshot_html"), blob("readable_html"), "pdf_data")
    page_rows = new.where(is_pdf).select("id", F.explode(pages).alias("p")).select(
        op.new_id("page", F.col("id"), F.col("p.page_num")).alias("id"), F.col("id").alias("entry_id"), "p.page_num", "p.text"
    )
    bridge, tags = _tagged(archive, new.select(F.col("id").alias("entry_id"), F.explode("tags").alias("name")), op)
    added = {"entries": entries, "entry_content": content, "pdf_pages": page_rows, "tags": tags, "entry_tags": bridge}
    return _with_rows(archive, added, op)


def _tagged(archive: Tables, wanted: DataFrame, op: Operation) -> tuple[DataFrame, DataFrame]:
    """New rows of the bridge and of ``tags`` for ``wanted(entry_id, name)``."""
    wanted = wanted.distinct()
    known = archive["tags"].select("name", F.col("id").alias("tag_id"))
    fresh = wanted.select("name").distinct().join(known, "name", "left_anti").select(op.new_id("tag", F.col("name")).alias("id"), "name")
    every = known.unionByName(fresh.select("name", F.col("id").alias("tag_id")))
    return wanted.join(every, "name").select("entry_id", "tag_id"), fresh


def _with_rows(archive: Tables, added: Tables, op: Operation) -> Tables:
    out = dict(archive)
    for table, rows in added.items():
        out[table] = archive[table].unionByName(rows, allowMissingColumns=True)
        out["change_log"] = out["change_log"].unionByName(_logged(rows, table, op), allowMissingColumns=True)
    return out


def _logged(rows: DataFrame, table: str, op: Operation, marker: str = ROW) -> DataFrame:
    """A whole row's change for each of ``rows``."""
    return op.stamped(rows.select(F.lit(table).alias("tbl"), row_key(table).alias("row_id"), F.lit(marker).alias("col"), F.lit(None).cast("string").alias("val")))


def _logged_columns(rows: DataFrame, table: str, columns: list[str], op: Operation) -> DataFrame:
    """A change for each of the ``columns`` of ``rows(row_id, …)`` that isn't null."""
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), _spelled(rows, c).alias("val")) for c in columns))
    out = rows.select("row_id", F.explode(pairs).alias("c")).where("c.val is not null")
    return op.stamped(out.select(F.lit(table).alias("tbl"), "row_id", "c.col", "c.val"))


def _spelled(rows: DataFrame, column: str) -> Column:
    """A value as the log's text: times in RFC 3339, bytes in Base64."""
    kind = dict(rows.dtypes)[column]
    if kind == "timestamp":
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    if kind == "binary":
        return F.regexp_replace(F.base64(column), r"[\r\n]", "")
    return F.col(column).cast("string")


def updated(archive: Tables, edits: DataFrame, op: Operation) -> Tables:
    """The archive after ``edits(id, title, tags)``: a null title or null tags stay as they are; the time of change is set
    in any case. Edits of unknown ids do nothing."""
    edits = edits.join(archive["entries"].select("id"), "id", "left_semi")
    e = archive["entries"].join(edits.select("id", F.col("title").alias("_title"), F.lit(True).alias("_hit")), "id", "left")
    changed = e.withColumns({"title": F.coalesce("_title", "title"), "updated_at": F.when(F.col("_hit"), op.time).otherwise(F.col("updated_at"))})
    out = dict(archive, entries=changed.select(*archive["entries"].columns))
    log = _logged_columns(edits.select(F.col("id").alias("row_id"), "title", op.time.alias("updated_at")), "entries", ["title", "updated_at"], op)
    out["change_log"] = archive["change_log"].unionByName(log, allowMissingColumns=True)
    return _retagged(out, edits.where(F.col("tags").isNotNull()).select(F.col("id").alias("entry_id"), "tags"), op)


def _retagged(archive: Tables, lists: DataFrame, op: Operation) -> Tables:
    """Each entry of ``lists(entry_id, tags)`` has those tags and no others; what is already there isn't touched."""
    wanted = lists.select("entry_id", F.explode("tags").alias("name"))
    bridge, tags = _tagged(archive, wanted, op)
    old = archive["entry_tags"].join(lists.select("entry_id"), "entry_id", "left_semi")
    gone, fresh = old.join(bridge, ["entry_id", "tag_id"], "left_anti"), bridge.join(old, ["entry_id", "tag_id"], "left_anti")
    out = dict(archive, entry_tags=archive["entry_tags"].join(gone, ["entry_id", "tag_id"], "left_anti"))
    out["change_log"] = out["change_log"].unionByName(_logged(gone, "entry_tags", op, TOMBSTONE), allowMissingColumns=True)
    return _with_rows(out, {"tags": tags, "entry_tags": fresh}, op)


def content_updated(archive: Tables, edits: DataFrame, op: Operation) -> Tables:
    """The archive after ``edits(id, extracted_text, snapshot_html, readable_html)``: nulls stay as they are; a new text
    counts its words anew."""
    edits = edits.join(archive["entries"].select("id"), "id", "left_semi")
    parts = ["extracted_text", "snapshot_html", "readable_html"]
    c = archive["entry_content"].join(edits.select(F.col("id").alias("entry_id"), *(F.col(p).alias(f"_{p}") for p in parts)), "entry_id", "left")
    c = c.withColumns({p: F.coalesce(f"_{p}", p) for p in parts}).select(*archive["entry_content"].columns)
    counted = edits.select("id", F.when(F.col("extracted_text").isNotNull(), X.word_count("extracted_text")).alias("_count"), F.lit(True).alias("_hit"))
    e = archive["entries"].join(counted, "id", "left")
    e = e.withColumns({"word_count": F.coalesce("_count", "word_count"), "updated_at": F.when(F.col("_hit"), op.time).otherwise(F.col("updated_at"))})
    log = _logged_columns(edits.withColumnRenamed("id", "row_id"), "entry_content", parts, op)
    counts = counted.select(F.col("id").alias("row_id"), F.col("_count").alias("word_count"), op.time.alias("updated_at"))
    log = log.unionByName(_logged_columns(counts, "entries", ["word_count", "updated_at"], op))
    return dict(archive, entries=e.select(*archive["entries"].columns), entry_content=c, change_log=archive["change_log"].unionByName(log, allowMissingColumns=True))


def deleted(archive: Tables, ids: DataFrame, op: Operation) -> Tables:
    """The archive without the entries ``ids(id)`` and all that is theirs, with their tombstones. Unknown ids do nothing."""
    ids = ids.select("id").distinct().join(archive["entries"].select("id"), "id", "left_semi")
    out = dict(archive, entries=archive["entries"].join(ids, "id", "left_anti"))
    log = [_logged(ids, "entries", op, TOMBSTONE)]
    for table, owner in OWNED.items():
        if table in archive:
            theirs = ids.select(F.col("id").alias(owner))
            if table in ("entry_content", "pdf_pages", "entry_tags"):
                log.append(_logged(archive[table].join(theirs, owner, "left_semi"), table, op, TOMBSTONE))
            out[table] = archive[table].join(theirs, owner, "left_anti")
    for part in log:
        out["change_log"] = out["change_log"].unionByName(part, allowMissingColumns=True)
    graves = op.stamped(ids.select(F.lit("entries").alias("tbl"), F.col("id").alias("row_id")))
    old = archive["tombstones"].join(graves.select("tbl", "row_id"), ["tbl", "row_id"], "left_anti")
    out["tombstones"] = old.unionByName(graves, allowMissingColumns=True)
    return out


def stored(archive: Tables, before: Tables | None = None) -> Tables:
    """The archive written to the shared folder and read again, but for tables that are the same as ``before``.

    Operations refer to the tables before them several times, so each should start from written ones.
    """
    out = {}
    for table, rows in archive.items():
        if before is not None and before.get(table) is rows:
            out[table] = rows
            continue
        path = scratch(rows.sparkSession, f"archive-{table}")
        rows.write.parquet(path)
        out[table] = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return out


def one(rows: DataFrame, value: object, key: str = "id"):
    """The row of a key; an unknown one is an error."""
    found = rows.where(F.col(key) == F.lit(value)).limit(1).collect()
    if not found:
        raise KeyError(f"no row with {key} {value!r}")
    return found[0]


def seeded(archive: Tables, op: Operation) -> DataFrame:
    """A log that holds every row of the archive once, parents first: what a replica starts from."""
    parts = [_logged(archive[t], t, op) for t in ("entries", "tags", "entry_content", "entry_tags", "pdf_pages")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def exported(archive: Tables, since: int) -> tuple[DataFrame, DataFrame]:
    """What a peer that has everything up to version ``since`` lacks: changes ``tbl, row_id, col, val`` and clocks, with
    whole rows spelled out column by column (rows that are gone give none), and tombstones, one a row."""
    log = archive["change_log"].where(F.col("db_version") > since)
    clock = ["hlc_ts", "hlc_counter", "site_id", "db_version"]
    out = log.where(~F.col("col").isin(ROW, TOMBSTONE)).select("tbl", "row_id", "col", "val", *clock)
    whole = log.where(F.col("col") == ROW).select("tbl", "row_id", *clock)
    for table in ("entries", "tags", "entry_content", "entry_tags", "pdf_pages"):
        rows = archive[table]
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        pairs = F.array(*(F.struct(F.lit(c).alias("col"), _spelled(rows, c).alias("val")) for c in columns if c in rows.columns))
        cells = rows.select(F.lit(table).alias("tbl"), row_key(table).alias("row_id"), F.explode(pairs).alias("c")).select("tbl", "row_id", "c.col", "c.val")
        out = out.unionByName(whole.where(F.col("tbl") == table).join(cells, ["tbl", "row_id"]).select("tbl", "row_id", "col", "val", *clock))
    marks = log.where(F.col("col") == TOMBSTONE).select("tbl", "row_id", *clock)
    graves = archive["tombstones"].where(F.col("db_version") > since).select("tbl", "row_id", *clock).join(marks, ["tbl", "row_id"], "left_anti")
    return out, marks.unionByName(graves)

