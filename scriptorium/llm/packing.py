"""Packing of tokenised documents into training sequences of a fixed capacity, shortest pack first.

1. Documents are tokenised; an end id follows each. What exceeds the capacity is cut into full pieces, so every
   document gives full pieces and at most one shorter piece. Each task numbers its pieces of every length.
2. The histogram of piece lengths, at most ``capacity`` rows, goes to the driver. Lengths are placed longest first,
   each into the pack with the most free space that takes it. Packs that hold the same lengths are one pattern with
   a count, so the work does not depend on the number of documents.
3. Every slot of a pattern takes a range of the ranks of its length. Pieces get their rank from their number in the
   task and the task's offset, and join the ranges by rank: no window runs over pieces, so a length that a third of
   all documents share costs no more than others.

Defined results: a null text counts as empty; an empty text is the end id alone; a text of any length is kept whole;
repeated rows are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 1
CACHE_ENTRIES = 300_000
#: Fixed value: how byte-level BPE of the 50k vocabulary cuts a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes a byte as its Latin-1 letter if that prints, else as the next letter from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library's file.

    A text is split at the file's added tokens, which keep their ids. Elsewhere a blank before a sign that isn't white
    space always starts a token, so the text is cut there and the segments' ids come from a bounded cache.
    """

    CUT = re.compile(r" (?=\S)")

    def __init__(self, path: str):
        self.cache: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        in_order = [vocab[a + b] for a, b in pairs]
        added = spec["added_tokens"]
        plain = not spec["normalizer"] and spec["pre_tokenizer"]["type"] == "ByteLevel"
        plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in added)
        if plain and in_order == sorted(in_order) and not spec["pre_tokenizer"]["add_prefix_space"]:
            import tiktoken

            letters = _byte_letters()
            self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.added}
            self._ids = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            self.cut = self.CUT.split
        else:  # another kind of tokenizer: no cuts, and the library itself
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self.added = {}
            self._ids = lambda text: library.encode(text, add_special_tokens=False).ids
            self.cut = lambda text: [text]
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.split = re.compile("(" + "|".join(longest) + ")").split if longest else lambda text: [text]

    def _encoded(self, segment: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self._ids(segment))

    def __call__(self, text: str) -> bytes:
        parts = self.split(text)
        if len(parts) == 1:
            return self._ordinary(text)
        return b"".join(self.added[p] if n % 2 else self._ordinary(p) if p else b"" for n, p in enumerate(parts))

    def _ordinary(self, text: str) -> bytes:
        first, *rest = self.cut(text)
        out, cache = [self._encoded(first)], self.cache
        for s in rest:
            ids = cache.get(s)
            if ids is None:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                ids = self._encoded(" " + s)
                if len(s) <= 32:
                    cache[s] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, task, nth`` (and ``ids``) of every piece.

    ``nth`` counts the task's pieces of that length from 0. Written to the shared folder, so both are lasting.
    """
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"
    names = [c.split()[0] for c in schema.split(", ")]
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = _encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            ids: list[list[int]] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                data = encode(text.as_py() or "") + end
                total, doc_id = len(data) // 4, doc.as_py()
                for start in range(0, total, capacity):
                    cut = data[4 * start : 4 * (start + capacity)]
                    n = len(cut) // 4
                    for column, value in zip(out, (doc_id, start, n, zlib.crc32(cut), total, task, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
                    if with_ids:
                        ids.append(list(memoryview(cut).cast("I")))
            arrays = [pa.array(column, pa.int64()) for column in out]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [*names, *["ids"] * with_ids])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return common.materialise(rows.mapInArrow(run, schema), "pieces")


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs for ``histogram`` (length to count), by shortest pack first.

    Each length ends at most one pattern early and opens at most two, so there are at most three for each length.
    """
    free_of: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in range(capacity, length - 1, -1):
            while left and free_of[free]:
                count, held = free_of[free].pop()
                if count > left:
                    free_of[free].append((count - left, held))
                free_of[free - length].append((min(count, left), (*held, length)))
                left -= min(count, left)
        each = capacity // length
        for count, held in ((left // each, each), (int(left % each > 0), left % each)):
            if count:
                free_of[capacity - held * length].append((count, (length,) * held))
    return [p for free in free_of for p in free]


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (columns of :func:`pieces`) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    counts = common.materialise(parts.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, used, sequence = [], Counter(), 0
    for count, lengths in patterns(histogram, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    slot_rows = spark.createDataFrame(slots, "length long, first long, beyond long, sequence long, offset long")

    # A task's pieces of a length have neighbouring ranks: cut each such run at the slots' borders.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = runs.join(slot_rows, "length").where((F.col("first") < F.col("at") + F.col("n")) & (F.col("at") < F.col("beyond")))
    cut = cut.select(
        "task",
        "length",
        F.greatest(F.col("first") - F.col("at"), F.lit(0)).alias("from"),
        (F.col("beyond") - F.col("at")).alias("to"),
        (F.col("sequence") + F.col("at") - F.col("first")).alias("base"),
        "offset",
    )
    # A row for each task and length: it grows with the input, so it is never broadcast.
    placed = parts.join(cut.hint("merge"), ["task", "length"]).where((F.col("nth") >= F.col("from")) & (F.col("nth") < F.col("to")))
    return placed.withColumn("sequence_id", F.col("base") + F.col("nth")).drop("task", "nth", "from", "to", "base")
