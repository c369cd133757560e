"""The change feed as a stream: every batch is merged into a table of winning cells, in parts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes

PARTS = 64


def _part() -> F.Column:
    return F.pmod(F.xxhash64(*changes.CELL), F.lit(PARTS)).cast("int")


def follow(log: DataFrame, state_path: str, checkpoint: str, every: str | None = None):
    """Starts a query that keeps the winning cells under ``state_path``.

    Cells are kept in parts by a hash of their key. A batch reads and writes anew only the parts that it has changes
    for, and ends with a manifest that names the batch each part was last written by: what it costs follows its size
    and not that of the state. A batch that runs again writes the same rows, so the result is exactly once.
    ``every``: a trigger interval; without it all that there is is read and the query ends.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        held = _manifest(spark, state_path, n - 1) if n else {}
        rows = batch.withColumn("part", _part())
        hit = sorted(r["part"] for r in rows.select("part").distinct().collect())  # PARTS at most
        old = [f"{state_path}/batch-{held[p]}/part={p}" for p in hit if p in held]
        if old:
            before = spark.read.schema(batch.schema).parquet(*old)
            rows = rows.unionByName(before.withColumn("part", _part()))
        best = changes.latest_cells(rows).withColumn("part", _part()).select(*batch.columns, "part")
        best.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{state_path}/batch-{n}")
        now = held | {p: n for p in hit}
        frame = spark.createDataFrame(sorted(now.items()), "part int, batch long")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/manifest-{n}")

    writer = log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _manifest(spark: SparkSession, state_path: str, n: int) -> dict[int, int]:
    return {r["part"]: r["batch"] for r in spark.read.parquet(f"{state_path}/manifest-{n}").collect()}  # PARTS at most


def state(spark: SparkSession, state_path: str, query, schema) -> DataFrame:
    """The winning cells after the query's last batch."""
    if not query.lastProgress:
        return spark.createDataFrame([], schema)
    held = _manifest(spark, state_path, query.lastProgress["batchId"])
    paths = [f"{state_path}/batch-{n}/part={p}" for p, n in held.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_of_changes(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The change log of ``events`` as a stream."""
    from .windows import event_stream

    e = event_stream(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("seq"),
        F.lit("events").alias("tbl"),
        F.col("user_id").alias("row_id"),
        F.col("event_type").alias("col"),
        F.col("value").alias("val"),
        F.unix_millis("ts").alias("hlc_ts"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("hlc_counter"),
        F.concat(F.lit("site-"), F.col("user_id") % 3).alias("site_id"),
        F.col("event_id").alias("db_version"),
    )
