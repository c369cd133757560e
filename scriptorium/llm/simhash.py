"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprint: of the XXH64 hashes of a text's word shingles, each bit is set that is set in more than half of them.
Two fingerprints link when they differ in at most ``radius`` bits.

Covering hashing (Pagh 2016) finds every such pair. Each of the 64 positions has a non-zero vector of radius + 1 bits;
table v, for each of the 2 ** (radius + 1) - 1 non-zero v, keeps the positions whose vector has an odd product with v.
At most ``radius`` differing positions have vectors that span less than the whole space, so some v is orthogonal to
all of them: its mask covers none of them, and the pair shares a key in that table.

Only distinct fingerprints are hashed. A key shared by few of them has its pairs compared. A key shared by more than
``BUCKET`` of them holds a dense group; there each fingerprint is also listed under itself and each of its single-bit
changes, and those that share an entry are linked to the least of it: two fingerprints with a common neighbour at one
bit differ in at most two, and two that differ in at most two have a common neighbour. So links in dense groups cost
65 entries a fingerprint, not a square, and none is lost. Other even radii list all changes of half as many bits;
odd ones are refused.

Defined results: A-Z is lower-cased and nothing else; words are split at ASCII white space; fewer words than a shingle
has give one shingle, no words give fingerprint zero, which links like any other; a null text counts as empty;
repeated rows and null ids are rows like others (a component's id is the least id that isn't null); an empty table
gives an empty result; other columns are ignored; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 3
SEED = 42
RADIUS = 2
BUCKET = 8


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, as unsigned 64-bit integers."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(64)]
    odd = lambda v: sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2)
    return [odd(v) for v in range(1, 1 << radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) and the columns ``carry``, written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *carry)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_text") + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t.as_py(), words)) for t in batch.column("_text")]
            out = batch.drop_columns(["_text"])
            yield out.append_column("fp", pa.array(values, pa.int64()))

    return common.materialise(rows.mapInArrow(run, schema), "fingerprints")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` between the values of ``distinct(fp)``: enough to connect every two that link, and no others."""
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks(radius))))
    keyed = distinct.select("fp", F.explode(tables).alias("m")).select("fp", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = common.materialise(keyed.join(sizes, ["t", "key"]), "shared-keys")
    few = shared.where(F.col("n") <= bucket)
    other = few.select("t", "key", F.col("fp").alias("other"))
    pairs = few.join(other, ["t", "key"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
    pairs = pairs.select(F.col("fp").alias("a"), F.col("other").alias("b"))

    if radius % 2:
        raise ValueError("dense groups are linked exactly for even radii only")
    # Dense keys: listed under every fingerprint within half the radius (rounded up), then linked through the least.
    changes = [0] + [sum(1 << i for i in c) for n in range(1, radius // 2 + 1) for c in combinations(range(64), n)]
    dense = shared.where(F.col("n") > bucket).select("fp").distinct()
    entries = dense.select("fp", F.explode(F.array(*(F.lit(_signed(c)) for c in changes))).alias("change"))
    entries = entries.select("fp", F.col("fp").bitwiseXOR(F.col("change")).alias("entry"))
    heads = entries.groupBy("entry").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = entries.join(heads, "entry").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    bucket: int = BUCKET,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row, ``root`` (one for each component) and the columns ``carry``."""
    rows = fingerprints(docs, id_col, text_col, words, carry)
    owners = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "owners")
    # Hashed nodes: the order of the contraction must not follow the bits.
    found = components(links(owners.select("fp"), radius, bucket).select(_node("a"), _node("b")))
    linked = owners.withColumn("node", F.xxhash64("fp")).join(found, "node", "left")
    root = F.coalesce("root", "node")
    groups = common.materialise(linked.select("fp", "least", root.alias("root")), "groups")
    heads = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(groups.join(heads, "root").select("fp", "component_id", "root"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *carry)


def _node(col: str):
    return F.xxhash64(col).alias(col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every component the row with the least id."""
    (row,) = common.unused(docs, "row")
    numbered = common.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    slim = numbered.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row).alias("number"))
    found = near_duplicates(slim, words=words, radius=radius, carry=("number",))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "number")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = found.join(best, "root").where("number <> best.number").select(F.col("number").alias(row))
    return common.without(numbered, row, common.materialise(gone, "gone")).drop(row)
