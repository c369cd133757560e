"""Overlapping chunks of texts, cut at sentence ends where there is one near the window's end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

SIZE, OVERLAP, LEAST = 2000, 400, 100
#: Text that leaves in one batch, whatever the texts' number and length.
BATCH_CHARS = 1 << 20


def sentence_end(text: str, low: int, high: int) -> int:
    """The position after the last ``.``, ``!`` or ``?`` of text[low:high] with white space behind, else ``high``."""
    for at in range(high - 1, low - 1, -1):
        if text[at] in ".!?" and at + 1 < len(text) and text[at + 1].isspace():
            return at + 1
    return high


def split(text: str) -> list[str]:
    """Texts below 100 bytes have no chunk, up to 2000 bytes one; windows are 2000 characters and overlap by 400."""
    text = text.strip()
    size = len(text.encode("utf-8", "surrogatepass"))
    if size < LEAST:
        return []
    if size <= SIZE:
        return [text]
    out, at = [], 0
    while at < len(text):
        stop = min(at + SIZE, len(text))
        if stop < len(text):
            stop = sentence_end(text, at + SIZE - OVERLAP, stop)
        piece = text[at:stop].strip()
        if len(piece.encode("utf-8", "surrogatepass")) >= LEAST:
            out.append(piece)
        at += max(stop - at - OVERLAP, 1) if stop > at + OVERLAP else SIZE - OVERLAP
    return out


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of (id, text) rows, in batches of a bounded size."""
    for batch in batches:
        out, size = [], 0
        for row, key in enumerate(batch.column(0).to_pylist(), 1):
            pieces = split(batch.column(1)[row - 1].as_py() or "")
            out += [(key, n, piece) for n, piece in enumerate(pieces)]
            size += sum(map(len, pieces))
            if size >= BATCH_CHARS or row == batch.num_rows:
                ids, places, texts = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(texts, pa.string())], ["entry_id", "chunk_index", "chunk_text"]
                )
                out, size = [], 0


def chunked(rows: DataFrame, id_col: str = "entry_id", text_col: str = "extracted_text") -> DataFrame:
    """``entry_id, chunk_index, chunk_text``, numbered from 0 in each entry."""
    kind = dict(rows.dtypes)[id_col]
    return spread(rows.select(F.col(id_col), F.col(text_col))).mapInArrow(cut, f"entry_id {kind}, chunk_index int, chunk_text string")
