"""Near copies: SimHash, then all pairs of a Jaccard similarity of 0.8 that its radius does not reach.

Two texts link when the sets of their word shingles have a Jaccard similarity of at least 0.8. Candidates come from
two sources, and each is compared by its shingles' bytes before it links:

1. SimHash fingerprints within the radius, by covering masks (``simhash``). This joins dense groups of copies.
2. Prefix filtering (Chaudhuri 2006), because texts of that similarity may differ in more bits than masks can cover:
   with all sets in one common order, the first n - ceil(0.8 n) + 1 shingles of two such sets share one. The order is
   by hash, after which come frequent shingles; which ones are frequent is estimated from a sample, and any choice
   gives the same links. Only shingles that several texts have, and whose texts the first step has not all connected,
   are followed. In rounds each text is compared with a few others, the heads of shingles that it shares most of,
   which are drawn anew each round; this connects groups whose texts are alike. What still differs is compared with one another.
   A pair is a candidate only if the number of shingles shared in both prefixes leaves room for the similarity.

So a dense group costs no square, and no pair is lost: what isn't compared is connected already. Of the texts only
those of candidates are moved: a small filter is broadcast that nearly all others fail.

Defined results: as in ``simhash``; texts without words have one empty shingle, so they are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

WORDS = 5
SEED = 42
#: The similarity that links, as a fraction of integers.
PART, WHOLE = 4, 5
#: Comparisons for each text in a round, the most rounds, and one in how many must link for a round to follow.
HEADS, ROUNDS, RARE = 4, 4, 50
#: Texts of a block of candidates, on average.
BLOCK = 2_000
#: One in so many rows is read for frequent shingles, and of them at most so many are put last.
SAMPLE, FREQUENT, FREQUENT_ROWS = 8, 400_000, 4


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def linked(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is at least ``PART / WHOLE``."""
    shared = len(a & b)
    return WHOLE * shared >= PART * (len(a) + len(b) - shared)


def _hashes(text: str | None, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    found = shingles(text, words)
    return np.sort(np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found)).view(np.int64))


def _keys(rows: DataFrame, words: int, last: np.ndarray | None) -> DataFrame:
    """``node, key, at, size``: a row's prefix with the shingles ``last`` at the end of the order; all without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                nodes, keys, at, sizes = [], [], [], []
                for node, text in zip(part.column("node").to_pylist(), part.column("_text").to_pylist(), strict=True):
                    own = _hashes(text, words)
                    size = len(own)
                    if last is not None:
                        at_last = np.minimum(np.searchsorted(last, own), max(len(last) - 1, 0))
                        late = last[at_last] == own if len(last) else np.zeros(size, bool)
                        own = np.concatenate([own[~late], own[late]])[: size - -(-PART * size // WHOLE) + 1]
                    nodes.append(np.full(len(own), node, np.int64))
                    keys.append(own)
                    at.append(np.arange(len(own), dtype=np.int32))
                    sizes.append(np.full(len(own), size, np.int32))
                columns = [pa.array(np.concatenate(c)) for c in (nodes, keys, at, sizes)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "key", "at", "size"])

    return rows.select("node", "_text").mapInArrow(run, "node long, key long, at int, size int")


def _frequent(rows: DataFrame, words: int) -> np.ndarray:
    """Shingles of many rows of a sample; at most ``FREQUENT`` numbers reach the driver."""
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
    counted = _keys(some, words, None).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT_ROWS)
    found = counted.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    return np.sort(np.array([r["key"] for r in found], np.int64))


def _checked(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``a, b``: those of the candidates ``pairs(a, b)`` that link.

    Texts are dealt into blocks of about ``BLOCK``; a pair of blocks is one group of rows, to which a text goes once
    however many of its pairs are there, and where its shingles are made once.
    """
    with common.passing(rows.sparkSession) as store:
        return store(_compared(pairs, rows, words), "links")


def _compared(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    few = common.materialise(pairs.select("a", "b").where("a <> b").distinct(), "candidates")
    side = lambda df, end, *columns: df.select(*columns, F.col(end).alias("node")).distinct()
    held = common.materialise(side(few, "a").union(side(few, "b")).distinct(), "candidate-nodes")
    blocks = F.lit(max(1, -(-held.count() // BLOCK)))
    placed = few.withColumns({"i": F.pmod("a", blocks), "j": F.pmod("b", blocks)})
    # Columns of their own: both sides of the groups come from the candidates.
    at = (F.col("i") + 0).alias("i"), (F.col("j") + 0).alias("j")
    ends = side(placed, "a", *at).union(side(placed, "b", *at)).distinct()
    texts = common.maybe_among(rows, F.col("node"), held).join(ends, "node").select("i", "j", "node", "_text")

    def run(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sets = {n: shingles(t, words) for n, t in zip(held["node"], held["_text"], strict=True)}
        keep = [linked(sets[a], sets[b]) for a, b in zip(some["a"], some["b"], strict=True)]
        return some.loc[np.array(keep, bool), ["a", "b"]]

    return placed.groupBy("i", "j").cogroup(texts.groupBy("i", "j")).applyInPandas(run, "a long, b long")


def _possible(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(a, at_a, size_a, b, at_b, size_b)``, a row for each key of both prefixes, those that can link: with
    ``both``, the number of these keys. Beyond the first shared key no more than the rest of either set is shared."""
    found = pairs.groupBy("a", "b", "size_a", "size_b").agg(
        F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"), F.count(F.lit(1)).alias("both")
    )
    left = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    room = left * (PART + WHOLE) >= (F.col("size_a") + F.col("size_b")) * PART
    return found.where(room & (F.col("both") >= _need("size_a", "size_b"))).select("a", "b", "both")


def by_fingerprint(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Links among texts whose SimHash fingerprints lie within the radius."""
    prints = simhash.fingerprints(rows, "node", "_text", words).withColumnRenamed("doc_id", "node")
    owners = common.materialise(prints.groupBy("fp").agg(F.min("node").alias("owner")), "owners")
    same = prints.join(owners, "fp").select(F.col("owner").alias("a"), F.col("node").alias("b"))
    side = lambda end: owners.select(F.col("fp").alias(f"fp_{end}"), F.col("owner").alias(end))
    pairs = simhash.links(owners.select("fp")).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    return _checked(same.union(pairs.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b")), rows, words)


def links(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Edges ``a, b`` between the nodes of ``rows(node, _text)``: enough to connect every two that link, and no others."""
    with common.passing(rows.sparkSession) as store:
        near = store(by_fingerprint(rows, words), "near")
    with common.passing(rows.sparkSession) as store:
        keys = common.materialise(_keys(rows, words, _frequent(rows, words)), "prefixes", "zstd")
        several = common.materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys")
        shared = store(common.maybe_among(keys, F.col("key"), several), "shared", "zstd")
    side = lambda end: [F.col(c).alias(c if c == "node" else f"{c}_{end}") for c in ("node", "at", "size")]
    head = [F.col("head.node").alias("a"), F.col("head.at").alias("at_a"), F.col("head.size").alias("size_a")]
    held = _mixed(shared, components(near), "shared-prefixes")
    for turn in range(ROUNDS):
        place = lambda salt: F.struct(F.xxhash64("node", F.lit(salt)), "node", "at", "size", "root")
        drawn = F.array_distinct(F.array(*(F.min(place(turn * HEADS + i)) for i in range(HEADS)))).alias("heads")
        stars = held.join(held.groupBy("key").agg(drawn), "key").withColumn("head", F.explode("heads"))
        stars = stars.where(F.col("root") != F.col("head.root")).select(*head, *side("b")).withColumnRenamed("node", "b")
        best = F.slice(F.sort_array(F.collect_list(F.struct("both", "a")), False), 1, HEADS)  # one for each key at most
        pairs = _possible(stars).groupBy("b").agg(best.alias("best")).select("b", F.explode("best.a").alias("a"))
        pairs = common.materialise(pairs, "pairs")
        found = _checked(pairs, rows, words)
        near = near.union(found)
        held = _mixed(held.drop("root"), components(near), "mixed-prefixes")
        if found.count() * RARE < pairs.count():
            break

    return near.union(_checked(_across(held), rows, words))


def _need(a: str, b: str) -> Column:
    """How many shingles of both prefixes two texts must share for the similarity, by their sizes.

    WHOLE * shared >= PART * (a + b - shared) needs a least number of shared shingles. Of the two prefixes that which
    ends first holds all shared ones up to its end; after it come size - prefix = ceil(PART / WHOLE * size) - 1 more.
    """
    after = F.ceil(F.greatest(a, b) * PART / WHOLE) - 1
    return F.greatest(F.ceil((F.col(a) + F.col(b)) * PART / (PART + WHOLE)) - after, F.lit(1))


def _across(held: DataFrame) -> DataFrame:
    """Candidates ``a, b`` among the texts of ``held(key, node, size, root)`` whose components differ.

    Two sets of keys that share at least n share one of the first size - n + 1 of both, in any common order. In that of
    rising frequency these are the rarest keys, so that common ones make few pairs.
    """
    times = held.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    rare = F.row_number().over(Window.partitionBy("node").orderBy("times", "key"))  # a text's prefix at most
    count = F.count(F.lit(1)).over(Window.partitionBy("node"))
    ranked = common.materialise(held.join(times, "key").select("key", "node", "size", "root", rare.alias("nth"), count.alias("count")), "ranked")
    side = lambda end: [F.col("key"), F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("size", "root", "nth", "count"))]
    # Sizes alone rule most pairs out.
    fits = (F.col("size_a") * WHOLE >= F.col("size_b") * PART) & (F.col("size_b") * WHOLE >= F.col("size_a") * PART)
    need = _need("size_a", "size_b")
    early = (F.col("nth_a") + need <= F.col("count_a") + 1) & (F.col("nth_b") + need <= F.col("count_b") + 1)
    pairs = ranked.select(*side("a")).join(ranked.select(*side("b")), "key")
    return pairs.where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits & early).select("a", "b")


def _mixed(held: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """``held(key, node, at, size)`` with ``root``, of the keys whose nodes lie in more than one component."""
    with common.passing(held.sparkSession) as store:
        rooted = common.materialise(held.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
        return store(rooted.join(mixed, "key"), label)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every component the row with the least id."""
    (row,) = common.unused(docs, "row")
    numbered = common.numbered(docs, row)
    # Hashed nodes: the order of the contraction must not follow the rows. XXH64 of a long is one-to-one.
    node = F.xxhash64(row).alias("node")
    rows = numbered.select(node, F.col(text_col).cast("string").alias("_text"))
    with common.passing(docs.sparkSession) as store:
        found = components(links(rows, words))
        held = numbered.select(node, F.col(row).alias("row"), F.col(id_col).cast("long").alias("id")).join(found, "node")
        best = held.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
        gone = store(held.join(best, "root").where("row <> best.row").select(F.col("row").alias(row)), "gone")
    return common.without(numbered, row, gone).drop(row)
