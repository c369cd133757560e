"""Listing, filtering, paging and bulk maintenance of entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import pdf

MOST_ROWS = 200
SORT_KEYS = {"title": "title", "updated_at": "updated_at"}


@dataclass(frozen=True)
class ListParams:
    content_type: str | None = None
    domain: str | None = None
    tag: str | None = None
    sort: str = "created_at"
    order: str = "desc"
    limit: int = 50
    offset: int = 0


def filtered(entries: DataFrame, params: ListParams, entry_tags: DataFrame | None = None) -> DataFrame:
    """All equality filters; a tag is a semi-join, so no entry is doubled."""
    for name in ("content_type", "domain"):
        if (value := getattr(params, name)) is not None:
            entries = entries.where(F.col(name) == value)
    if params.tag is not None and entry_tags is not None:
        ids = entry_tags.where(F.col("tag") == params.tag).select(F.col("entry_id").alias("id"))
        entries = entries.join(ids, "id", "left_semi")
    return entries


def page(entries: DataFrame, params: ListParams, created: str = "created_s") -> DataFrame:
    """One page: unknown sort keys mean the time of creation, any order but ``asc`` is descending, ties by id."""
    key = SORT_KEYS.get(params.sort, created)
    key = key if key in entries.columns else created
    by = F.col(key).asc() if params.order == "asc" else F.col(key).desc()
    rows = entries.orderBy(by, "id").offset(max(params.offset, 0))
    return rows.limit(min(params.limit, MOST_ROWS)) if params.limit >= 0 else rows


def with_tags(entries: DataFrame, entry_tags: DataFrame) -> DataFrame:
    """``tags``: a sorted array, empty for entries without any. One join for all entries."""
    lists = entry_tags.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return entries.join(lists, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def by_ids(entries: DataFrame, ids: DataFrame, created: str = "created_s") -> DataFrame:
    """Those of ``ids(id)`` that exist, newest first."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi").orderBy(F.desc(created), "id")


def missing(entries: DataFrame, derived: DataFrame, derived_key: str = "entry_id") -> DataFrame:
    """Entries for which a derived table has no row: what a backfill still has to do."""
    return entries.join(derived.select(F.col(derived_key).alias("id")), "id", "left_anti")


def to_reprocess(rows: DataFrame, version: int) -> DataFrame:
    """PDF rows with a file whose text is empty, whose status is failed or pending, or whose version is old."""
    stale = (
        (F.coalesce("extracted_text", F.lit("")) == "")
        | F.coalesce("index_status", F.lit("ok")).isin("failed", "pending")
        | (F.coalesce("index_version", F.lit(0)) < version)
    )
    return rows.where((F.col("content_type") == "pdf") & F.col("pdf_data").isNotNull() & stale)


def pdf_requests(files: DataFrame) -> DataFrame:
    """Requests to save the files ``path, content``: their pages, their text and a title out of the path."""
    numbered = files.select(F.xxhash64("path").alias("request"), "path", "content")
    pages = pdf.pages(numbered).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_num", "text"))).alias("pages"))
    none = F.lit(None).cast("binary")
    return numbered.join(pages, "path", "left").select(
        "request", F.lit(None).cast("string").alias("url"), X.file_title("path").alias("title"), F.lit("pdf").alias("content_type"),
        F.lit("").alias("extracted_text"), none.alias("snapshot_html"), none.alias("readable_html"), F.col("content").alias("pdf_data"),
        "pages", F.array().cast("array<string>").alias("tags"), F.lit("cli").alias("source"),
    )


def reprocessed(rows: DataFrame, version: int, id_col: str = "id") -> DataFrame:
    """``rows`` with the text, page count, status and version that reading their ``pdf_data`` again gives."""
    files = rows.select(F.col(id_col).cast("string").alias("path"), F.col("pdf_data").alias("content"))
    found = pdf.whole_texts(pdf.pages(files))
    old = rows.drop("extracted_text", "page_count", "index_status", "index_version").withColumn("path", F.col(id_col).cast("string"))
    out = old.join(found, "path", "left").withColumns({"extracted_text": F.coalesce("text", F.lit("")), "page_count": F.coalesce("page_count", F.lit(0))})
    return out.withColumns({"index_status": index_status(F.col("extracted_text"), F.col("page_count")), "index_version": F.lit(version)}).drop("text", "path")


def index_status(text: Column, pages: Column | None = None) -> Column:
    """``failed`` where there is no text (and, for a PDF, no page), else ``ok``."""
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty & (pages == 0) if pages is not None else empty, "failed").otherwise("ok")


def transferred(source: DataFrame, target: DataFrame, id_col: str = "id", url_col: str = "url") -> DataFrame:
    """Rows of another archive to copy: neither id nor URL known here, and of equal URLs the least id.

    Rows without a URL are told apart by id alone.
    """
    fresh = source.join(target.select(id_col), id_col, "left_anti")
    fresh = fresh.join(target.where(F.col(url_col).isNotNull()).select(url_col), url_col, "left_anti")
    # A minimum combines on the map side, so a URL that many rows share is one row for each task.
    rest = [c for c in source.columns if c != url_col]
    least = F.min(F.struct(id_col, *(c for c in rest if c != id_col))).alias("first")
    with_url = fresh.where(F.col(url_col).isNotNull()).groupBy(url_col).agg(least).select(url_col, *(F.col(f"first.{c}").alias(c) for c in rest))
    return with_url.unionByName(fresh.where(F.col(url_col).isNull())).select(*source.columns)


def existing_urls(entries: DataFrame, urls: DataFrame) -> DataFrame:
    """``url, id`` of the entries that already hold one of ``urls(url)``."""
    return entries.join(urls.select("url").distinct(), "url", "left_semi").select("url", "id")


def edit_tags(tags: Column, add: list[str] = (), remove: list[str] = ()) -> Column:
    """Trimmed, lower-cased tags added if absent, others removed; order kept."""
    norm = lambda xs: F.array(*(F.lit(x.strip().lower()) for x in xs)).cast("array<string>")
    return F.array_except(F.array_union(tags, norm(add)), norm(remove))


def export_rows(entries: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Rows as JSON lines; with content, the text and the sizes of the stored files. No cap."""
    rows = entries
    if content is not None:
        blobs = [c for c, t in content.dtypes if t == "binary"]
        sized = content.select("entry_id", "extracted_text", *(F.octet_length(c).alias(f"{c}_bytes") for c in blobs))
        rows = rows.join(sized.withColumnRenamed("entry_id", "id"), "id", "left")
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
