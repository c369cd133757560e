"""Event-time windows. The same functions take a stream or a batch.

:func:`followed` writes windows as the watermark passes them and drops their state then, so the state of an endless
stream is bounded by how late its events may be. :func:`drained` gives all windows of a finite stream, also those that
the watermark hasn't passed at its end, and holds the state of all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

LATE = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of one file; the time is cast because a watermark needs a zoned one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    return _counted(events, F.window("ts", size), late)


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = LATE) -> DataFrame:
    return _counted(events, F.window("ts", size, step), late)


def _counted(events: DataFrame, window, late: str) -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    out = grouped.agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a finite stream gives, as a table in the shared folder: each batch replaces the one before."""
    spark = stream.sparkSession
    path = scratch(spark, name)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{n}")

    writer = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}-checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # no batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/{query.lastProgress['batchId']}")


def followed(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts a query that appends windows to ``path`` as soon as the watermark has passed them."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
