"""Connected components of an undirected graph, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``, longs; nodes of a component share a root, one of them.

    A round points every node at its least neighbour (or itself) and contracts along these pointers, so a component
    loses a constant share of its nodes in each round; nodes should be hashes, so that their order is unrelated to
    the graph. Each round is written to the shared folder. Nodes are grouped with a partial aggregation, and only
    plain joins see a hot node, which Spark splits: no task needs all edges of a node.
    """
    spark = edges.sparkSession
    edges = common.materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        level = common.materialise(least.select("node", F.least("node", "b").alias("root")), "level")
        levels.append(level)
        left = edges.join(level.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        both_ends = left.join(level.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        contracted = both_ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = common.materialise(contracted.distinct(), "edges")
    else:
        raise RuntimeError("the components did not settle")
    if not levels:
        return spark.createDataFrame([], "node long, root long")
    # A root of one level may be a node of the next: follow the pointers from the last level to the first.
    found = levels[-1]
    for level in reversed(levels[:-1]):
        onward = found.select(F.col("node").alias("root"), F.col("root").alias("further"))
        inner = level.join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        found = inner
    return found
