"""Session settings for a laptop; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "scriptorium") -> SparkSession:
    cores = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows for costly functions: dealt out anew where there are fewer partitions than cores, as from one small file.

    Large inputs have more partitions than that and stay where they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


@lru_cache(8)
def _application_folder(root: str, application: str) -> str:
    """A folder of this application under the shared one; it goes when the application ends."""
    jvm = SparkSession.getActiveSession()._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/scriptorium-{application}")
    fs = path.getFileSystem(SparkSession.getActiveSession()._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    uri = fs.makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


@lru_cache(1)
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="scriptorium-")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, under the session's ``spark.checkpoint.dir``.

    Only a local session, where both are one machine, may do without that setting. The folder is removed when the
    application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_root()
    return _application_folder(root.rstrip("/"), spark.sparkContext.applicationId)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
