"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


#: Paths of the scratch tables made in the innermost scope of ``passing``.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by, so that other libraries find the same file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; the folder goes when the application ends."""
    path = scratch(spark, label)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def materialise(df: DataFrame, label: str, compression: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back.

    This cuts the lineage, fixes anything not deterministic (row ids) and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a column ``row``, a number that is each row's own and the same whenever the table is read.

    Rows of Parquet files are numbered by their file and their place in it, which no split of the work changes. Any
    other input is copied once to the shared folder, because it might give its rows in another order the next time.
    """
    if not _stored(docs):
        return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    path, at, nth = unused(docs.withColumn(row, F.lit(0)), "path", "at", "nth")
    place = docs.metadataColumn("_metadata")
    placed = docs.select("*", place.getField("file_path").alias(path), place.getField("row_index").alias(at))
    names = sorted(r[0] for r in placed.select(path).distinct().collect())  # files, of which the driver has a list anyway
    files = docs.sparkSession.createDataFrame([(name, n << 40) for n, name in enumerate(names)], f"`{path}` string, `{nth}` long")
    return placed.join(F.broadcast(files), path).withColumn(row, F.col(nth) + F.col(at)).drop(path, at, nth)


def _stored(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of Parquet files under one path as it was read (a file named twice is read twice)."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.isStreaming():
        return False
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return False
    return relation.location().rootPaths().size() == 1


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Scratch tables made inside are deleted at its end. What it gives stores a table, as ``materialise``, that stays.

    Nothing that is used later may read the others. Scopes nest: what stays belongs to the scope around, if there is one.
    """
    own: list[str] = []
    outer = _scope.get()
    token = _scope.set(own)

    def store(*args, **options) -> DataFrame:
        inner = _scope.set(outer)
        try:
            return materialise(*args, **options)
        finally:
            _scope.reset(inner)

    try:
        yield store
    finally:
        _scope.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def lowest(turn: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` of its range."""
    return F.lit(True) if share >= 1 else turn < int(-(2**63) + share * 2**64)


#: The most rows of a filter that is broadcast: 64 bits each.
FILTER_WORDS = 1 << 20


class BitFilter:
    """Which of many 64-bit hashes may be among those of the first column of ``members``, a stored table.

    One bit a hash, 16 bits for each member, kept as rows of 64 bits in the shared folder and broadcast where rows are
    tested. It has at most ``most`` rows whatever the input; beyond that it lets more hashes pass, never fewer.
    """

    def __init__(self, members: DataFrame, most: int = FILTER_WORDS):
        self.words = 1 << max(6, min(most.bit_length() - 1, (members.count() // 4).bit_length()))
        place = self._place(F.col(members.columns[0]))
        rows = members.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(self._bit(place)).alias("bits"))
        self.rows = materialise(rows, "filter")

    def _place(self, hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(self.words * 64))

    def _bit(self, place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))

    def flagged(self, rows: DataFrame, hashed: Column) -> tuple[DataFrame, str]:
        """``rows`` with a boolean column, and its name: false where the hash is certainly not among the members'."""
        word, bits, place = unused(rows, "word", "bits", "place")
        table = self.rows.select(F.col("word").alias(word), F.col("bits").alias(bits))
        out = rows.withColumn(place, self._place(hashed)).withColumn(word, F.floor(F.col(place) / 64)).join(F.broadcast(table), word, "left")
        held = F.coalesce(F.col(bits).bitwiseAND(self._bit(F.col(place))) != 0, F.lit(False))
        return out.withColumn(bits, held).select(*rows.columns, bits), bits

    def passed(self, rows: DataFrame, hashed: Column) -> DataFrame:
        """The rows whose hash may be among the members': all that are, few others."""
        out, flag = self.flagged(rows, hashed)
        return out.where(flag).drop(flag)


def maybe_among(rows: DataFrame, hashed: Column, members: DataFrame) -> DataFrame:
    """Those rows that pass a filter of ``members``, so that what a join would drop isn't shuffled."""
    return BitFilter(members).passed(rows, hashed)


def without(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The rows whose 64-bit ``key`` is none of ``members(key)``, a stored table. Only rows that a filter doesn't clear
    are shuffled."""
    out, flag = BitFilter(members).flagged(rows, F.col(key))
    return out.where(~F.col(flag)).drop(flag).unionByName(out.where(flag).drop(flag).join(members, key, "left_anti"))
