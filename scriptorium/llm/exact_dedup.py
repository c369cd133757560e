"""Exact deduplication by a log-structured merge index of text digests.

Writing: a batch of documents is a memtable of entries (digest, best row, number of rows). It is flushed as a sorted run
of level 0. Compaction merges the runs of a level into one run of the next: entries of a digest become one that keeps
the best row (largest rank, then smallest id), and the run is written in ranges of the digest, each file sorted. Every
run has a bit filter of its digests; a lookup tests its digests with a run's filter and reads the run only if some
pass, and only those are joined.

Every digest with more than one row is a hit, and hits are compared byte for byte before any row is dropped; should two
texts share a SHA-256 digest, the job stops with an error rather than drop one of them. Only texts that pass the filter
of the hits are shuffled, and equal texts are combined on the map side first. Digests that a thousandth of all rows
or more share, a thousand at most, are broadcast instead of joined by a shuffle.

All steps are DataFrame expressions. Defined results: a null text counts as empty; empty texts (and texts of white space
only) are equal to each other like any others; repeated rows, even with the same id, are separate rows of which exactly
one is kept; null ids sort after all others; an empty table gives an empty result; extra columns of the input are
ignored, or pass through where whole rows are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Runs of a level that are merged into one of the next.
FAN = 4
SALTS = 16
#: A digest with this share of all rows is hot.
HOT = 1000
WHITE_SPACE = r"[\x20\x09-\x0D]+"

_ENTRY = "digest binary, best struct<rank: bigint, not_id: bigint, not_uid: bigint>, size bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, "")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _hash(digest: Column) -> Column:
    return F.xxhash64(digest)


@dataclass
class Run:
    path: str
    #: Of the digests' hashes.
    filter: common.BitFilter


class DigestIndex:
    """Runs under one folder, by level. ``flush`` adds a run to level 0 and compacts full levels."""

    def __init__(self, spark: SparkSession, root: str | None = None, fan: int = FAN):
        self.spark = spark
        self.root = root or common.scratch_path(spark, "digest-index")
        self.fan = fan
        self.levels: list[list[Run]] = []
        self.flushed = self.written = 0
        #: Paths of the runs that lookups have read.
        self.read: list[str] = []

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
        """Writes the batch as a run of level 0 and returns its rows ``digest, id, uid``, ``uid`` a lasting row number.

        ``row_col``: a column that already numbers the rows; without it numbers are dealt out here.
        """
        uid = F.col(row_col) if row_col else F.lit(self.flushed << 56) + F.monotonically_increasing_id()
        rank = F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long")
        best = F.struct(rank.alias("rank"), F.bitwise_not(F.col(id_col).cast("long")).alias("not_id"), F.bitwise_not(uid).alias("not_uid"))
        entries = docs.select(_digest(normalised(F.col(text_col))).alias("digest"), best.alias("best"), F.lit(1).cast("long").alias("size"))
        run = self._write(entries.sortWithinPartitions("digest"), 0)
        self.flushed += 1
        rows = self._entries(run).select("digest", F.bitwise_not("best.not_id").alias("id"), F.bitwise_not("best.not_uid").alias("uid"))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                self.compact(level)
        return rows

    def _write(self, entries: DataFrame, level: int) -> Run:
        path = f"{self.root}/level-{level}-run-{self.written}"
        self.written += 1
        entries.write.parquet(path)
        run = Run(path, common.BitFilter(self.spark.read.schema(_ENTRY).parquet(path).select(_hash(F.col("digest")))))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def _entries(self, *runs: Run) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(*(r.path for r in runs))

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def compact(self, level: int | None = None) -> DataFrame:
        """Merges the runs of a level (of all levels without one) into one run, and returns its entries.

        The entries of a digest are combined on the map side, so a hot digest is one entry a task, then dealt out in
        ranges of the digest and sorted. Files of merged runs stay until the folder goes: rows may still read them.
        """
        old = self.runs() if level is None else self.levels[level]
        merged = merge(self._entries(*old))
        if level is None:
            level, self.levels = len(self.levels), []
        else:
            self.levels[level] = []
        return self._entries(self._write(merged.repartitionByRange("digest").sortWithinPartitions("digest"), level + 1))

    def lookup(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Rows of ``docs`` whose digest the index already holds, with the id that it keeps (``known_id``, replaced).

        The caller verifies bytes where it holds the older text; :func:`exact_duplicates` does so itself.
        """
        (digest,) = common.unused(docs, "digest")
        probe = docs.drop("known_id").withColumn(digest, _digest(normalised(F.col(text_col))))
        asked = common.materialise(probe.select(F.col(digest).alias("digest")).distinct(), "asked")
        found = self._entries()
        for run in self.runs():
            some = common.materialise(run.filter.passed(asked, _hash(F.col("digest"))), "asked-of-run")
            if not some.isEmpty():  # else the run certainly holds none of them
                self.read.append(run.path)
                found = found.union(self._entries(run).join(some, "digest", "left_semi"))
        known = merge(found).select(F.col("digest").alias(digest), F.bitwise_not("best.not_id").alias("known_id"))
        return probe.join(known, digest).drop(digest)


def merge(entries: DataFrame) -> DataFrame:
    """One entry a digest: the best row (largest rank, then smallest id, null ids last, then smallest row number)."""
    return entries.groupBy("digest").agg(F.max("best").alias("best"), F.sum("size").alias("size"))


def _verify(docs: DataFrame, hits: DataFrame, text_col: str) -> None:
    """Raises an error if texts of one digest differ. ``hits(digest, hash)``: digests of more than one row.

    A hot digest is spread over SALTS tasks; there its equal texts combine before the next shuffle, which gets one
    row for a text and task.
    """
    texts = docs.select(normalised(F.col(text_col)).alias("norm")).withColumn("digest", _digest(F.col("norm")))
    texts = common.BitFilter(hits.select("hash")).passed(texts, _hash(F.col("digest")))
    salted = hits.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    suspects = texts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left_semi")
    kinds = suspects.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clashes = common.materialise(kinds.where("texts > 1"), "digest-clashes")
    if not clashes.isEmpty():
        raise ValueError("two texts share a SHA-256 digest: " + clashes.first()["digest"].hex())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, fan: int = FAN) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256`` (and ``uid``, its row number)."""
    index = DigestIndex(docs.sparkSession, fan=fan)
    rows = index.flush(docs, id_col, text_col, row_col)
    merged = index.compact()
    hits = common.materialise(merged.where("size > 1").select("digest", _hash(F.col("digest")).alias("hash")), "digest-hits")
    _verify(docs, hits, text_col)

    total = merged.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("size") * HOT >= max(total, HOT * HOT)
    group = merged.select("digest", "best", "size")
    near = rows.join(F.broadcast(group.where(hot)), "digest", "left")  # HOT rows at most
    far = near.where("best is null").select("digest", "id", "uid").join(group.where(~hot), "digest")
    return near.where("best is not null").unionByName(far).select(
        F.col("id").alias("doc_id"),
        F.bitwise_not("best.not_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("uid") == F.bitwise_not("best.not_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "uid",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    (row,) = common.unused(docs, "row")
    numbered = common.numbered(docs, row)
    with common.passing(docs.sparkSession) as store:
        gone = exact_duplicates(numbered, id_col, text_col, row).where("not kept").select(F.col("uid").alias(row))
        gone = store(gone, "gone")
    return common.without(numbered, row, gone).drop(row)
