"""Change logs of several replicas: last writer wins by hybrid logical clock, cell by cell.

A clock is (hlc_ts, hlc_counter, site_id), compared field by field: Spark's order of structs. The winner of a cell is
a maximum over its changes, so merging is an aggregation: commutative, associative, idempotent, with a partial step
before the shuffle. A row written as a whole stands in the log under the column ``__row__`` and its clock counts for
all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__row__"
CLOCK = ("hlc_ts", "hlc_counter", "site_id")
CELL = ("tbl", "row_id", "col")
#: Parents before what refers to them.
TABLE_ORDER = {"entries": 0, "tags": 0, "entry_content": 1, "entry_tags": 1, "pdf_pages": 1}


def clock(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in CLOCK))


def since(log: DataFrame, version: int) -> DataFrame:
    """What a peer whose cursor is ``version`` has not seen, in order."""
    return log.where(F.col("db_version") > version).orderBy("seq")


def latest_cells(log: DataFrame) -> DataFrame:
    """The winning change of each cell, with its clock."""
    rest = [c for c in ("val", "seq", "db_version") if c in log.columns]
    best = log.groupBy(*CELL).agg(F.max(F.struct(clock().alias("clock"), *rest)).alias("b"))
    return best.select(*CELL, *(F.col(f"b.clock.{c}").alias(c) for c in CLOCK), *(F.col(f"b.{c}").alias(c) for c in rest))


def merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The cells of both logs after the merge; the same for either order of the two."""
    return latest_cells(local.unionByName(remote))


def to_apply(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote changes that win: newer than the cell's and the whole row's last local change, or without any."""
    cells = local.groupBy(*CELL).agg(F.max(clock()).alias("at"))
    own = cells.where(F.col("col") != ROW).withColumnRenamed("at", "cell_at")
    whole = cells.where(F.col("col") == ROW).select("tbl", "row_id", F.col("at").alias("row_at"))
    joined = remote.join(own, list(CELL), "left").join(whole, ["tbl", "row_id"], "left")
    newest = F.greatest("cell_at", "row_at")
    return joined.where(newest.isNull() | (clock() > newest)).select(*remote.columns)


def latest_tombstones(tombstones: DataFrame) -> DataFrame:
    best = tombstones.groupBy("tbl", "row_id").agg(F.max(clock()).alias("deleted_at"))
    return best


def without_deleted(cells: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Cells of rows that are not deleted: a tombstone removes a row if it is newer than all of its cells."""
    newest = cells.groupBy("tbl", "row_id").agg(F.max(clock()).alias("changed_at"))
    dead = latest_tombstones(tombstones).join(newest, ["tbl", "row_id"]).where(F.col("deleted_at") > F.col("changed_at"))
    return cells.join(dead.select("tbl", "row_id"), ["tbl", "row_id"], "left_anti")


def applied(archive: dict[str, DataFrame], changes: DataFrame, tombstones: DataFrame, version: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The archive after a peer's ``changes`` and ``tombstones``, and one row ``applied``: rows inserted, cells updated and
    rows deleted.

    Tables are taken parents first. A row that isn't here is inserted from its cells; of a row that is, each cell that
    is newer than the local one is set. A tombstone newer than all local changes of its row deletes it and what is
    its own. What is applied is logged with its own clock and the local ``version``.
    """
    out, counts = dict(archive), []
    for table in sorted(TABLE_ORDER, key=lambda t: (TABLE_ORDER[t], t)):
        kinds = dict(out[table].dtypes)
        mine = latest_cells(changes.where(F.col("tbl") == table).where(F.col("col").isin(*kinds)))
        keyed = out[table].withColumn("row_id", row_key(table))
        new = mine.join(keyed.select("row_id"), "row_id", "left_anti")
        inserted = new.groupBy("row_id").agg(*(_value(c, kinds[c]).alias(c) for c in kinds))
        local = archive["change_log"].where(F.col("tbl") == table)
        wins = to_apply(local, mine.join(keyed.select("row_id"), "row_id", "left_semi"))
        sets = wins.groupBy("row_id").agg(*(F.max(F.struct(F.when(F.col("col") == c, F.lit(1)).otherwise(0).alias("set"), F.when(F.col("col") == c, F.col("val")).alias("val"))).alias(f"_{c}") for c in kinds))
        rows = keyed.join(sets, "row_id", "left")
        held = [F.when(F.col(f"_{c}.set") == 1, _typed(F.col(f"_{c}.val"), kinds[c])).otherwise(F.col(c)).alias(c) for c in kinds]
        out[table] = rows.select(*held).unionByName(inserted.select(*kinds))
        log = [c for c in archive["change_log"].columns if c in mine.columns and c != "db_version"]
        for part in (new, wins):
            out["change_log"] = out["change_log"].unionByName(part.select(*log).withColumn("db_version", F.lit(version).cast("long")), allowMissingColumns=True)
        counts += [inserted.select(F.lit("rows").alias("what")), wins.select(F.lit("cells").alias("what"))]
    newest = archive["change_log"].groupBy("tbl", "row_id").agg(F.max(clock()).alias("changed_at"))
    dead = latest_tombstones(tombstones).join(newest, ["tbl", "row_id"], "left").where(F.col("changed_at").isNull() | (F.col("deleted_at") > F.col("changed_at")))
    for table in TABLE_ORDER:
        gone = dead.where(F.col("tbl") == table).select("row_id")
        out[table] = out[table].withColumn("row_id", row_key(table)).join(gone, "row_id", "left_anti").drop("row_id")
        if table != "entries" and "entry_id" in out[table].columns:
            owners = dead.where(F.col("tbl") == "entries").select(F.col("row_id").alias("entry_id"))
            out[table] = out[table].join(owners, "entry_id", "left_anti").select(*archive[table].columns)
    graves = dead.select("tbl", "row_id", *(F.col(f"deleted_at.{c}").alias(c) for c in CLOCK), F.lit(version).cast("long").alias("db_version"))
    old = archive["tombstones"].join(graves.select("tbl", "row_id"), ["tbl", "row_id"], "left_anti")
    out["tombstones"] = old.unionByName(graves, allowMissingColumns=True)
    counts.append(dead.select(F.lit("tombstones").alias("what")))
    every = counts[0]
    for part in counts[1:]:
        every = every.unionByName(part)
    return out, every.agg(F.count(F.lit(1)).alias("applied"))


def row_key(table: str) -> Column:
    """The text by which the change log names a row."""
    return F.concat_ws("|", "entry_id", "tag_id") if table == "entry_tags" else F.col("entry_id") if table == "entry_content" else F.col("id")


def _typed(value: Column, kind: str) -> Column:
    """The log's text as a column's value; what can't be one is null."""
    if kind == "binary":
        return F.try_to_binary(value, F.lit("base64"))
    return value if kind == "string" else value.try_cast(kind)


def _value(column: str, kind: str) -> Column:
    return _typed(F.max(F.when(F.col("col") == column, F.col("val"))), kind)


def touched(changes: DataFrame) -> DataFrame:
    """``doc_id`` of the entries whose index has to be written anew after ``changes``."""
    return changes.where(F.col("tbl").isin("entries", "entry_content")).select(F.col("row_id").alias("doc_id")).distinct()


#: Kinds of values between replicas.
WIRE = {"bigint": "Integer", "int": "Integer", "double": "Real", "float": "Real", "string": "Text", "binary": "Blob"}


def to_wire(value: Column, kind: str) -> Column:
    """A value as JSON with its kind; bytes in Base64, nulls of kind ``Null``."""
    held = F.regexp_replace(F.base64(value), r"[\r\n]", "") if kind == "binary" else value
    spelled = F.to_json(F.struct(F.lit(WIRE[kind]).alias("t"), held.alias("v")))
    return F.when(value.isNull(), F.lit('{"t":"Null"}')).otherwise(spelled)


def from_wire(value: Column, kind: str) -> Column:
    """The inverse of :func:`to_wire`; a value of another kind, and bad Base64, is null (or empty bytes)."""
    held = F.get_json_object(value, "$.v")
    right = F.get_json_object(value, "$.t") == WIRE[kind]
    if kind == "binary":
        return F.when(right, F.coalesce(F.try_to_binary(held, F.lit("base64")), F.lit(b"")))
    return F.when(right, held if kind == "string" else held.try_cast(kind))


@dataclass
class SyncState:
    """What a replica keeps about itself, as rows ``key, value``."""

    site_id: str
    db_version: int = 0
    wall_ms: int = 0
    counter: int = 0

    @classmethod
    def loaded(cls, meta: DataFrame, new_site: str) -> SyncState:
        """From ``meta(key, value)``; what is missing or no number has its default."""
        held = {r["key"]: r["value"] for r in meta.where(F.col("key").isin("site_id", "db_version", "hlc_wall", "hlc_counter")).collect()}  # four rows
        number = lambda k: int(held[k]) if (held.get(k) or "").lstrip("-").isdigit() else 0
        return cls(held.get("site_id") or new_site, number("db_version"), number("hlc_wall"), number("hlc_counter"))

    def rows(self, spark: SparkSession) -> DataFrame:
        held = {"site_id": self.site_id, "db_version": self.db_version, "hlc_wall": self.wall_ms, "hlc_counter": self.counter}
        return spark.createDataFrame([(k, str(v)) for k, v in held.items()], "key string, value string")

    def clock(self) -> HybridClock:
        return HybridClock(self.site_id, self.wall_ms, self.counter)

    def next_version(self) -> int:
        self.db_version += 1
        return self.db_version


def to_rows(cells: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """One row a row id with the given columns; cells of other columns are left out."""
    return cells.groupBy(key).pivot("col", columns).agg(F.max("val"))


def from_rows(rows: DataFrame, key: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """``tbl, row_id, col, val`` (text) of every column of every row: a whole row's change, expanded."""
    columns = columns or [c for c in rows.columns if c != key]
    held = rows.select(F.col(key).alias("row_id"), *(F.col(c).cast("string") for c in columns))
    return held.unpivot("row_id", columns, "col", "val").select(F.lit(table).alias("tbl"), "row_id", "col", "val")


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``row_id, kind, columns`` of the rows that differ between two states; ``kind``: insert, delete or update."""
    side = lambda df, p: df.select(F.col(key).alias("row_id"), F.lit(True).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    both = side(before, "old").join(side(after, "new"), "row_id", "full")
    changed = F.filter(F.array(*(F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.size(changed) > 0, "update")
    found = both.select("row_id", kind.alias("kind"), F.when(kind == "update", F.array_join(changed, ",")).otherwise("").alias("columns"))
    return found.where(F.col("kind").isNotNull())


def compacted(log: DataFrame, peers: DataFrame) -> DataFrame:
    """The log without what every peer has: versions below the least of their cursors."""
    least = peers.agg(F.coalesce(F.min("last_db_version"), F.lit(0)).alias("v")).first()["v"]
    return log.where(F.col("db_version") >= least)


def pruned(tombstones: DataFrame, before_ms: int) -> DataFrame:
    return tombstones.where(F.col("hlc_ts") >= before_ms)


def update_cursors(peers: DataFrame, updates: DataFrame) -> DataFrame:
    """Peers with their highest known version; unknown peers are added."""
    both = peers.select("id", "last_db_version").unionByName(updates.select("id", "last_db_version"))
    return both.groupBy("id").agg(F.max("last_db_version").alias("last_db_version"))


@dataclass
class HybridClock:
    """Kulkarni et al. 2014: a wall clock that never runs back, a counter for equal times, a site."""

    site_id: str
    wall_ms: int = 0
    counter: int = 0

    def now(self, physical_ms: int) -> tuple[int, int, str]:
        if physical_ms > self.wall_ms:
            self.wall_ms, self.counter = physical_ms, 0
        else:
            self.counter += 1
        return self.wall_ms, self.counter, self.site_id

    def observe(self, remote: tuple[int, int, str], physical_ms: int) -> None:
        wall = max(self.wall_ms, remote[0], physical_ms)
        counters = [c for w, c in ((self.wall_ms, self.counter), (remote[0], remote[1])) if w == wall]
        self.counter = max(counters) + 1 if counters else 0
        self.wall_ms = wall
