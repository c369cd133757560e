"""Exact top-k search by inner product over two cover trees.

1. Every vector goes to the nearest of some centres, taken from a bounded sample, and the rows are dealt out and sorted
   by centre. So neighbouring rows form cells, and a cell of any size, even of equal vectors, is spread over tasks.
2. Each query is compared with the rows beside it. Its kth best score there is a bound for all that follows.
3. Queries are taken in blocks of bounded size, which are broadcast with their bounds. Each task builds one cover tree
   of the block and one of every run of a cell, and searches both together: for centres q, p and covering radii rq, rp
   no pair below scores more than <q, p> + rq |p| + rp |q| + rq rp, and a pair of nodes is pruned when that is less
   than the worst kth score among the queries below q. Scores are carried from run to run. Equal bounds are visited,
   so ties are exact. A task returns what it has found at or above the bounds, k rows for a query at most.

No row is shuffled for a query: what moves beyond the first sorting are bounds and results.

Scores are integers: components are scaled and floored. Products are summed in float64 where no sum can reach 2 ** 53;
elsewhere float64 rules candidates out, with a margin for its error, and Python's integers rank the rest.

Defined results: vectors that are null, hold null or non-finite components, or have no id take no part; empty vectors
score 0 with each other; vectors of another length than a query's are no candidates for it; rows are told apart by a
row number, so of repeated rows each is a candidate for the other; fewer than k candidates give fewer rows; a score
beyond a 64-bit integer is given as its bound, and such scores are ranked by task first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256
#: Rows of a cell on average, the most cells (their centres are broadcast), and rows that may be drawn for them.
CELL_ROWS, CELLS = 4_096, 4_096
#: The most rows of a cell in one tree, and the most queries in a block.
RUN, BLOCK = 8_192, 32_768
LEAF = 512
QUERY_LEAF = 128
FAN = 16


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    norm: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    #: The distance within which every row lies from the centre of its child.
    cover: float = 0.0


def cover_tree(points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Node:
    """A cover tree whose levels need no common base.

    Centres of a level are chosen farthest first, the parent's own first (nesting), until every point lies within half
    its parent's radius of one, or there are ``fan`` of them. The distance reached then is the level's scale: no point
    lies farther from the centre it goes to (covering), no two centres are nearer to each other (separation). Leaves
    hold at most ``leaf`` points, or points that are all the same.
    """
    return _node(points, np.arange(len(points)), leaf, fan)


def _node(points: np.ndarray, rows: np.ndarray, leaf: int, fan: int) -> Node:
    local = points[rows]
    with np.errstate(over="ignore", invalid="ignore"):
        squares = np.einsum("ij,ij->i", local, local)
        if not np.isfinite(squares.sum()):  # too large for distances: one leaf that is never pruned
            return Node(local[0], np.inf, np.inf, rows)
    away = lambda i: np.sqrt(np.maximum(squares - 2 * (local @ local[i]) + squares[i], 0))
    near = away(0)
    near[0] = 0
    radius = float(near.max())
    out = Node(local[0], radius * (1 + 1e-9), float(np.sqrt(squares[0])), rows)
    if len(rows) <= leaf or radius == 0:
        return out
    owner, centres = np.zeros(len(rows), np.int64), [0]
    while len(centres) < fan and near.max() > radius / 2:
        centres.append(int(near.argmax()))
        d = away(centres[-1])
        d[centres[-1]] = 0
        owner[d < near] = len(centres) - 1
        near = np.minimum(near, d)
    out.cover = float(near.max())
    for n, c in enumerate(centres):
        mine = np.flatnonzero(owner == n)
        mine = np.concatenate([[c], mine[mine != c]])
        out.children.append(_node(points, rows[mine], leaf, fan))
    return out


class Queries:
    """Queries of one length, their tree, and what has been found for them: scores, ids, by score, then smaller id."""

    def __init__(self, points: np.ndarray, uid: np.ndarray, least: np.ndarray, k: int = K):
        self.points, self.uid, self.k = points, uid, k
        self.least = least.astype(np.float64)
        self.largest = float(np.abs(points).max(initial=0))
        self.tree = cover_tree(points, QUERY_LEAF) if len(points) else None
        self.found: list[list[tuple]] = [[] for _ in points]

    def worst(self, rows: np.ndarray) -> float:
        return float(self.least[rows].min())

    def offer(self, rows: np.ndarray, points: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
        """Takes the best of ``points`` for the queries ``rows``; ``own``: uids of the points."""
        a = self.points[rows]
        size = a.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = a @ points.T
            largest = self.largest * float(np.abs(points).max(initial=0)) * max(size, 1)
            exact = largest < 2**53
            slack = 0.0 if exact else largest * size * 1e-15
            fits = ~(scores + slack < self.least[rows][:, None]) & (self.uid[rows][:, None] != own[None])
            for n in np.flatnonzero(fits.any(1)):
                q = rows[n]
                at = np.flatnonzero(fits[n])
                # Of float scores only those can stay that reach the kth best of this offer.
                if len(at) > self.k:
                    kth = np.partition(scores[n, at], -self.k)[-self.k]
                    at = at[~(scores[n, at] + 2 * slack < kth)]
                if exact:
                    new = [(-int(s), int(i)) for s, i in zip(scores[n, at], ids[at], strict=True)]
                else:
                    v = [int(x) for x in a[n]]
                    new = [(-sum(x * int(y) for x, y in zip(v, points[j], strict=True)), int(ids[j])) for j in at]
                best = sorted(self.found[q] + new)[: self.k]
                self.found[q] = best
                if len(best) == self.k:
                    kth = float(-best[-1][0])
                    self.least[q] = max(self.least[q], kth - slack)

    def search(self, points: np.ndarray, uid: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        """Offers all of ``points`` but those that no query below a node can need."""
        if self.tree is None or not len(points):
            return
        stack = [(np.inf, self.tree, cover_tree(points, leaf))]
        while stack:
            bound, q, p = stack.pop()
            if bound < self.worst(q.rows):
                continue
            if not q.children and not p.children:
                self.offer(q.rows, points[p.rows], uid[p.rows], ids[p.rows])
                continue
            # The side with the larger radius is opened; the most promising pair is visited first.
            pairs = [(c, p) for c in q.children] if q.children and (not p.children or q.radius > p.radius) else [(q, c) for c in p.children]
            stack += sorted(((_bound(a, b), a, b) for a, b in pairs), key=lambda x: x[0])


def _bound(q: Node, p: Node) -> float:
    with np.errstate(over="ignore", invalid="ignore"):
        b = float(q.centre @ p.centre) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
        b += 1e-9 * (abs(b) + (q.norm + q.radius) * (p.norm + p.radius))
    return np.inf if np.isnan(b) else b


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and no component null or not finite."""
    x = vector.cast("array<double>")
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _matrix(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """Scaled and floored float64 of vectors that have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(len(column), size)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.array(batch.column("v").value_lengths().to_numpy(zero_copy_only=False), np.int64)
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def _centres(rows: DataFrame, total: int, cell_rows: int, cells: int) -> dict[int, np.ndarray]:
    """Centres by length, from a sample of ``cells`` rows on average."""
    many = min(cells, -(-total // cell_rows))
    some = rows.where(common.lowest(F.xxhash64("id", "v"), many / max(1, total))).groupBy("v").agg(F.min("id").alias("id"))
    held = some.orderBy("id").limit(2 * cells).select("v").toArrow().column("v").combine_chunks()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    batch = pa.RecordBatch.from_arrays([held], names=["v"])
    return {size: _matrix(part.column("v"), size, 1) for size, part in _by_size(batch)} if len(held) else {}


def _assigned(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with ``size``, ``cell`` (the nearest centre of that length) and ``turn``, a count that spreads cells."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    schema = f"id long, v {dict(rows.dtypes)['v']}, asks boolean, size int, cell int, turn int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for size, part in _by_size(batch):
                mine = shared.value.get(size)
                cell = np.zeros(part.num_rows, np.int32)
                if mine is not None and size:
                    with np.errstate(over="ignore", invalid="ignore"):
                        squares = np.einsum("ij,ij->i", mine, mine)
                        for at in range(0, part.num_rows, 1024):
                            x = _matrix(part.column("v").slice(at, 1024), size, 1)
                            cell[at : at + 1024] = (squares - 2 * (x @ mine.T)).argmin(1)
                spread = (np.arange(turn, turn + part.num_rows) * 40_503 % 65_536).astype(np.int32)
                turn += part.num_rows
                columns = [*part.columns, pa.array(np.full(part.num_rows, size, np.int32)), pa.array(cell), pa.array(spread)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "asks", "size", "cell", "turn"])

    return rows.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Neighbouring rows of one length and cell, ``most`` at most."""
    held: list[pa.RecordBatch] = []
    last, count = None, 0
    for batch in batches:
        size, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "cell"))
        borders = np.flatnonzero((size[1:] != size[:-1]) | (cell[1:] != cell[:-1])) + 1
        for a, b in zip([0, *borders], [*borders, batch.num_rows], strict=True):
            while a < b:
                key = (size[a], cell[a])
                if held and (key != last or count >= most):
                    yield pa.Table.from_batches(held)
                    held, count = [], 0
                n = min(b - a, most - count)
                held.append(batch.slice(a, n))
                last, count, a = key, count + n, a + n
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _points(table: pa.Table, scale: int) -> np.ndarray:
    size = int(table.column("size")[0].as_py())
    return np.concatenate([_matrix(chunk, size, scale) for chunk in table.column("v").chunks])


def _with_bounds(points: DataFrame, k: int, scale: int, most: int) -> DataFrame:
    """The queries ``id, uid, size, v`` and ``least``, the kth best score among the rows beside them (null: too few)."""
    schema = f"id long, uid long, size int, v {dict(points.dtypes)['v']}, least double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, most):
            asks = np.flatnonzero(table.column("asks").to_numpy())
            if not len(asks):
                continue
            at, uid, ids = _points(table, scale), _numbers(table, "uid"), _numbers(table, "id")
            queries = Queries(at[asks], uid[asks], np.full(len(asks), -np.inf), k)
            queries.offer(np.arange(len(asks)), at, uid, ids)
            mine = table.take(pa.array(asks)).select(["id", "uid", "size", "v"])
            least = pa.array([x if x > -np.inf else None for x in queries.least], pa.float64())
            yield from mine.append_column("least", least).combine_chunks().to_batches()

    return points.mapInArrow(run, schema)


def _blocks(queries: DataFrame, most: int) -> Iterator[pa.Table]:
    """The rows of a stored table in parts of at most ``most`` (its files hold no more): whole files together."""
    spark = queries.sparkSession
    counts = queries.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()
    held, count = [], 0
    for r in counts:
        if held and count + r["n"] > most:
            yield spark.read.schema(queries.schema).parquet(*held).toArrow()
            held, count = [], 0
        held.append(r["file"])
        count += r["n"]
    if held:
        yield spark.read.schema(queries.schema).parquet(*held).toArrow()


def _found(points: DataFrame, block: pa.Table, k: int, scale: int, most: int) -> DataFrame:
    """``query_uid, query_id, vec_id, score``: the best of each task for the queries of the block."""
    sides = {}
    for batch in block.combine_chunks().to_batches():
        for size, part in _by_size(batch):
            least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            sides.setdefault(size, []).append((_matrix(part.column("v"), size, scale), _numbers(part, "uid"), _numbers(part, "id"), np.nan_to_num(least, nan=-np.inf)))
    shared = points.sparkSession.sparkContext.broadcast({size: tuple(map(np.concatenate, zip(*parts, strict=True))) for size, parts in sides.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, Queries] = {}
        for table in _runs(batches, most):
            size = int(table.column("size")[0].as_py())
            if size not in shared.value:
                continue
            if size not in queries:
                at, uid, _, least = shared.value[size]
                queries[size] = Queries(at, uid, least, k)
            queries[size].search(_points(table, scale), _numbers(table, "uid"), _numbers(table, "id"))
        for size, side in queries.items():
            _, uid, ids, _ = shared.value[size]
            out = [(uid[n], ids[n], i, max(-(2**63), min(2**63 - 1, -s))) for n, best in enumerate(side.found) for s, i in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_uid", "query_id", "vec_id", "score"])

    return points.mapInArrow(run, "query_uid long, query_id long, vec_id long, score long")


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    cell_rows: int = CELL_ROWS,
    cells: int = CELLS,
    run: int = RUN,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``is_query`` holds, the k best of all other rows."""
    spark = vectors.sparkSession
    asks = F.coalesce(is_query, F.lit(False)).alias("asks")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), asks)
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    total = rows.count()
    dealt = _assigned(rows, _centres(rows, total, cell_rows, cells)).repartitionByRange("size", "cell", "turn")
    dealt = dealt.sortWithinPartitions("size", "cell").drop("turn").withColumn("uid", F.monotonically_increasing_id())
    points = common.materialise(dealt, "vectors")
    queries = common.materialise(_with_bounds(points, k, scale, run), "queries", rows_per_file=block)
    parts = [common.materialise(_found(points, part, k, scale, run), "found") for part in _blocks(queries, block)]
    schema = "query_uid long, query_id long, vec_id long, score long"
    found = spark.read.schema(schema).parquet(*(f for p in parts for f in p.inputFiles())) if any(p.inputFiles() for p in parts) else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
