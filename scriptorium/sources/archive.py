"""The archive's tables as DataFrames: schemas, and the views that the test tables give.

Entries and their content are kept apart so that listing and tagging never read texts; lists of tags are a bridge
table. Derived tables (postings, chunks, keywords, vectors) are functions of these and can be rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

CONTENT_TYPES = ("article", "pdf")
SAVE_SOURCES = ("extension", "cli", "api")
INDEX_STATUSES = ("ok", "partial", "failed", "pending")

SCHEMAS: dict[str, str] = {
    "entries": "id string, url string, title string, content_type string, status string, domain string, word_count long, page_count long, created_at timestamp, updated_at timestamp, saved_by string, index_status string, index_version int",
    "entry_content": "entry_id string, extracted_text string, snapshot_html binary, readable_html binary, pdf_data binary",
    "pdf_pages": "id string, entry_id string, page_num int, text string",
    "tags": "id string, name string",
    "entry_tags": "entry_id string, tag_id string",
    "entry_embeddings": "entry_id string, embedding array<float>, model_version string, created_at timestamp",
    "entry_keywords": "entry_id string, keyword string, score double",
    "entry_chunks": "entry_id string, chunk_index int, chunk_text string, embedding array<float>, model_version string, created_at timestamp",
    "change_log": "seq long, tbl string, row_id string, col string, val string, hlc_ts long, hlc_counter long, site_id string, db_version long",
    "tombstones": "tbl string, row_id string, hlc_ts long, hlc_counter long, site_id string, db_version long",
    "sync_peers": "id string, name string, last_sync_at timestamp, last_db_version long",
    "sync_meta": "key string, value string",
    "schema_version": "version int, description string, applied_at timestamp",
}


@dataclass(frozen=True)
class Archive:
    """Tables of one archive by name; missing ones are empty."""

    spark: SparkSession
    root: str | None = None

    def table(self, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        if self.root is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def save(self, name: str, rows: DataFrame, mode: str = "overwrite") -> None:
        rows.write.mode(mode).parquet(f"{self.root}/{name}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as entries, without the text. A minute lies between two entries' times."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        X.first_line("text").alias("title"),
        F.when(F.col("doc_id") % 5 == 0, "pdf").otherwise("article").alias("content_type"),
        F.col("source").alias("domain"),
        "lang",
        X.word_count("text").alias("word_count"),
        (F.lit(1704067200) + F.col("doc_id") * 60).alias("created_s"),
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("extracted_text"))


def entry_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge ``entry_id, tag``: the language, the source's last digit, and what the labels say."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    own = d.select(F.col("doc_id").alias("entry_id"), F.explode(F.array(F.col("lang"), F.concat(F.lit("s"), F.right("source", F.lit(1))))).alias("tag"))
    marks = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("entry_id"),
        F.explode(F.array(F.concat(F.lit("quality-"), F.col("quality")), F.concat(F.lit("toxic-"), F.col("toxic")))).alias("tag"),
    )
    return own.union(marks).distinct()


def tags(spark: SparkSession) -> DataFrame:
    """All tag names, one of which no entry has. Fixed and small."""
    names = ["de", "en", "es", "fr", *(f"s{i}" for i in range(10)), "quality-0", "quality-1", "toxic-0", "toxic-1", "unused"]
    return spark.createDataFrame([(n,) for n in names], "tag string")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: a cell is (user, event type), its clock is (milliseconds, counter, site)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.lit("events").alias("tbl"),
        F.col("user_id").alias("row_id"),
        F.col("event_type").alias("col"),
        F.col("value").alias("val"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("hlc_ts"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("hlc_counter"),
        F.concat(F.lit("site-"), F.col("user_id") % 3).alias("site_id"),
        F.col("event_id").alias("db_version"),
    )
