"""Versions of an archive's tables: pending ones are applied in order, each as a whole or not at all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import SCHEMAS

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Migration:
    version: int
    description: str
    up: Callable[[SparkSession, Tables], Tables]


def _with(*names: str) -> Callable[[SparkSession, Tables], Tables]:
    """Adds empty tables that are not there."""
    return lambda spark, tables: tables | {n: spark.createDataFrame([], SCHEMAS[n]) for n in names if n not in tables}


def _indexed(spark: SparkSession, tables: Tables) -> Tables:
    """States of texts that were saved before there was a state: what has a text is fine, a PDF file without one failed."""
    has = tables["entry_content"].select(F.col("entry_id").alias("id"), (F.coalesce("extracted_text", F.lit("")) != "").alias("_has"))
    e = tables["entries"].join(has, "id", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    status = F.when((F.col("content_type") == "pdf") & ~F.col("_has"), "failed").otherwise("ok")
    e = e.withColumns({"index_status": F.coalesce("index_status", status), "index_version": F.coalesce("index_version", F.col("_has").cast("int"))})
    return tables | {"entries": e.select(*tables["entries"].columns)}


def _logged(spark: SparkSession, tables: Tables) -> Tables:
    """Change tracking: every row that is there is logged once, parents first."""
    from ..operators.saving import Operation, seeded

    out = _with("change_log", "tombstones", "sync_peers", "sync_meta")(spark, tables)
    log = seeded(out, Operation(0, 0, "migration", 0))
    return out | {"change_log": out["change_log"].unionByName(log, allowMissingColumns=True)}


MIGRATIONS = (
    Migration(1, "entries, texts, pages and tags", _with("entries", "entry_content", "pdf_pages", "tags", "entry_tags")),
    Migration(2, "index states", _indexed),
    Migration(3, "change tracking", _logged),
    Migration(4, "terms of the index", _with()),
    Migration(5, "vectors and keywords", _with("entry_embeddings", "entry_keywords")),
    Migration(6, "chunks", _with("entry_chunks")),
)


def current_version(tables: Tables) -> int:
    """The highest version that was applied, 0 for none."""
    if "schema_version" not in tables:
        return 0
    return tables["schema_version"].agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def migrated(spark: SparkSession, tables: Tables, migrations: tuple[Migration, ...] = MIGRATIONS) -> Tables:
    """The tables after all pending migrations. One that fails leaves those before it applied and raises ``MigrationError``."""
    out = _with("schema_version")(spark, tables)
    for m in sorted(migrations, key=lambda m: m.version):
        if m.version <= current_version(out):
            continue
        try:
            new = m.up(spark, out)
        except Exception as e:
            raise MigrationError(m.version, out) from e
        row = spark.range(1).select(F.lit(m.version).alias("version"), F.lit(m.description).alias("description"), F.current_timestamp().alias("applied_at"))
        out = new | {"schema_version": out["schema_version"].unionByName(row)}
    return out


def applied(tables: Tables) -> DataFrame:
    return tables["schema_version"].orderBy("version")


class MigrationError(RuntimeError):
    def __init__(self, version: int, tables: Tables):
        super().__init__(f"migration {version} failed")
        self.version, self.tables = version, tables
