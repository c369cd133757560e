"""SentencePiece encoding by suffix-array matching, and decoding.

A batch's text is cut into units before every run of word-start signs, which no piece of such a vocabulary crosses;
units that the task has met before come from a bounded cache. The others are concatenated, each behind a sentinel,
and indexed by a suffix array, as deep as the longest piece. Every piece of the vocabulary is binary-searched in it
for its range of occurrences. The occurrences are edges (start, end, piece), sorted by position and then relaxed:

* unigram models: the path of edges with the highest sum of scores (Viterbi);
* BPE models: of all neighbouring symbols that an edge spans, those with the best score merge first, the leftmost of
  equals first, until no edge spans two neighbours. A path of highest sum would not be what a BPE model means.

Characters that no piece covers become byte pieces where the model has them, else the unknown id.

Defined results: a null or empty text has no ids; any length of text is encoded whole; decoding gives the text back
but for what the model's own normalisation changes (U+2581 decodes as a blank); repeated rows and null ids of
documents are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
BATCH_CHARS = 4 << 20
CACHE_ENTRIES = 500_000
CUT_AT = SPACE + ".,\n"
LONG_UNIT = 256


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder of one model file, whose normalisation must be the identity."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap:
            raise ValueError("the model normalises characters; only identity models are supported")
        self.bpe = model.trainer_spec.model_type == 2
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), 0)
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        normal: list[tuple[str, int, float]] = []
        for i, p in enumerate(model.pieces):
            raw = p.piece.encode()
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], raw = i, bytes([value])
            elif p.type in (2, 3):
                raw = b" \xe2\x81\x87 " if p.type == 2 else b""
            else:
                normal.append((p.piece, i, p.score))
            self.bytes_of.append(raw.replace(SPACE.encode(), b" "))
        self.pieces = [p for p, _, _ in normal]
        self.piece_id = np.array([i for _, i, _ in normal], np.int64)
        self.piece_score = np.array([s for _, _, s in normal], np.float64)
        self.depth = max(map(len, self.pieces))
        self.cut = re.compile(self._borders()).split
        self.points = np.zeros((len(self.pieces), self.depth), np.int64)  # code points, 0 where a piece has ended
        for row, piece in zip(self.points, self.pieces, strict=True):
            row[: len(piece)] = list(map(ord, piece))
        self.cache: dict[str, bytes] = {}

    def _borders(self) -> str:
        """Where a text can be cut: beside these signs, between two characters that no piece holds in a row."""
        rows = {a + b for p in self.pieces for a, b in zip(p, p[1:], strict=False)}
        some = lambda chars: "".join(map(re.escape, chars))
        out = []
        for c in CUT_AT:
            before, after = some(r[0] for r in rows if r[1] == c), some(r[1] for r in rows if r[0] == c)
            out.append(f"(?<=[^{before}])(?={re.escape(c)})" if before else f"(?<=.)(?={re.escape(c)})")
            if c != SPACE:
                out.append(f"(?<={re.escape(c)})(?=[^{after}])" if after else f"(?<={re.escape(c)})(?=(?s:.))")
        return "|".join(out)

    def units(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return self.cut((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        cut = [self.units(t or "") for t in texts]
        fresh = set().union(*cut).difference(self.cache)
        known = dict(zip(fresh, self._encode_units(list(fresh)), strict=True)) if fresh else {}
        if len(self.cache) < CACHE_ENTRIES:  # frequent units come early, so a full cache stays as it is
            self.cache.update((k, v) for k, v in known.items() if len(k) <= 32)
        cache, late = self.cache.get, known.get
        return [b"".join([cache(u) or late(u, b"") for u in units]) for units in cut]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        text = b"".join([of[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def _encode_units(self, units: list[str]) -> list[bytes]:
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(units)), lengths)
        where = np.arange(len(points)) + unit  # a sentinel follows each unit
        alphabet, dense = np.unique(points, return_inverse=True)
        text = np.zeros(len(points) + len(units) + self.depth, np.int64)
        text[where] = dense + 1
        key, score, ids = self._edges(text, where, alphabet)
        merged = self._merge(where, unit, key, score) if self.bpe else self._viterbi(where, unit, key, score)
        start, end, owner = merged
        return self._ids(points, where, unit, start, end, owner, key, ids, len(units))

    def _edges(self, text: np.ndarray, where: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (start * 64 + length), scores and ids of all occurrences of pieces."""
        bits = max(1, int(len(alphabet) + 1).bit_length())
        per = 63 // bits
        words = -(-self.depth // per)
        codes = np.zeros((len(where), words), np.int64)
        for w in range(words):
            for j in range(w * per, (w + 1) * per):
                codes[:, w] <<= bits
                if j < self.depth:
                    codes[:, w] |= text[where + j]
        order = np.lexsort(codes.T[::-1])  # the suffix array
        suffixes = codes[order]

        at = np.minimum(np.searchsorted(alphabet, self.points), len(alphabet) - 1)
        row = np.where(alphabet[at] == self.points, at + 1, 0)
        blank = self.points == 0
        which = np.flatnonzero(((row > 0) | blank).all(1))
        row, blank = row[which], blank[which]

        def packed(fill: int) -> np.ndarray:
            filled = np.where(blank, fill, row)
            out = np.full((len(which), words), 0, np.int64)
            for j in range(words * per):
                out[:, j // per] = out[:, j // per] << bits | (filled[:, j] if j < self.depth else fill)
            return out

        if not len(which):
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        first, beyond = _search(suffixes, packed(0), False), _search(suffixes, packed((1 << bits) - 1), True)
        count = beyond - first
        piece = np.repeat(which, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        length = self.depth - blank.sum(1)
        key = where[order[at]] * 64 + np.repeat(length, count)
        by = np.argsort(key, kind="stable")
        return key[by], self.piece_score[piece[by]], self.piece_id[piece[by]]

    @staticmethod
    def _merge(where, unit, key, score):
        """Start, end and unit of the symbols that are left of each unit."""

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if not len(key):
                return np.full(len(a), -np.inf)
            want = a * 64 + np.minimum(b - a, 63)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            return np.where(key[at] == want, score[at], -np.inf)

        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        start, end, owner = where, where + 1, unit
        sizes = np.bincount(unit)
        long = sizes[unit] > LONG_UNIT
        if long.any():
            for u in np.unique(unit[long]):
                at = where[unit == u]
                a, b = _merge_long(at, lambda a, b: float(pair(np.array([a]), np.array([b]))[0]))
                done.append((a, b, np.full(len(a), u)))
            start, end, owner = start[~long], end[~long], owner[~long]
        best = np.full(len(start), -np.inf)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        best[same] = pair(start[same], end[same + 1])
        while len(start):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.append(heads, len(owner)))
            peak = np.maximum.reduceat(best, heads)
            live = np.repeat(peak > -np.inf, counts)
            if not live.all():
                done.append((start[~live], end[~live], owner[~live]))
                start, end, owner, best = start[live], end[live], owner[live], best[live]
                keep = peak > -np.inf
                peak, counts = peak[keep], counts[keep]
                heads = np.cumsum(counts) - counts
            if not len(start):
                break
            index = np.arange(len(start))
            at = np.minimum.reduceat(np.where(best == np.repeat(peak, counts), index, len(start)), heads)
            end[at] = end[at + 1]
            gone = np.zeros(len(start), bool)
            gone[at + 1] = True
            shift = np.cumsum(gone)
            start, end, owner, best = start[~gone], end[~gone], owner[~gone], best[~gone]
            at = at - shift[at]
            best[at] = -np.inf
            right = at[(at + 1 < len(start)) & (owner[np.minimum(at + 1, len(start) - 1)] == owner[at])]
            best[right] = pair(start[right], end[right + 1])
            left = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            best[left] = pair(start[left], end[left + 1])
        if not done:
            return start, end, owner
        start, end, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(start, kind="stable")
        return start[by], end[by], owner[by]

    def _viterbi(self, where, unit, key, score):
        """The path of highest sum; a character that no piece covers costs more than any piece."""
        if not len(where):
            return where, where, unit
        edges: dict[int, list[tuple[int, float]]] = {}
        for k, s in zip(key.tolist(), score.tolist(), strict=True):
            edges.setdefault(k // 64, []).append((k % 64, s))
        lost = float(self.piece_score.min()) - 10.0
        out = []
        heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        for u0, u1 in zip(heads.tolist(), np.append(heads[1:], len(unit)).tolist(), strict=True):
            first, n = int(where[u0]), u1 - u0
            total, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
            for i in range(n):
                found = edges.get(first + i, [])
                if not any(length == 1 for length, _ in found):
                    found = [*found, (1, lost)]
                for length, s in found:
                    if total[i] + s > total[i + length]:
                        total[i + length], back[i + length] = total[i] + s, i
            path, i = [], n
            while i:
                path.append((first + back[i], first + i, int(unit[u0])))
                i = back[i]
            out += path[::-1]
        start, end, owner = (np.array(x, np.int64) for x in zip(*out, strict=True))
        return start, end, owner

    def _ids(self, points, where, unit, start, end, owner, key, ids, units) -> list[bytes]:
        if not len(start):
            return [b""] * units
        want = start * 64 + np.minimum(end - start, 63)
        at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        found = key[at] == want if len(key) else np.zeros(len(want), bool)
        out = np.where(found, ids[at] if len(ids) else 0, -1).astype(np.int64)
        if not found.all():
            chars = points[np.searchsorted(where, start[~found])]
            spelled = [[self.byte_id.get(b, self.unknown) for b in chr(c).encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown] for c in chars.tolist()]
            times = np.ones(len(out), np.int64)
            times[~found] = [len(s) for s in spelled]
            out, owner = np.repeat(out, times), np.repeat(owner, times)
            out[out < 0] = [i for s in spelled for i in s]
        raw = out.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=units)) * 4
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _merge_long(at: np.ndarray, pair) -> tuple[np.ndarray, np.ndarray]:
    """The merges of one long unit, with a heap."""
    n, first = len(at), int(at[0])
    end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and end[j] - i <= 63:
            s = pair(first + i, first + end[j])
            if s > -np.inf:
                heapq.heappush(heap, (-s, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or end[i] != middle or j >= n or end[j] != stop:
            continue
        end[i], alive[j], nxt[i] = stop, False, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    left = [i for i in range(n) if alive[i]]
    return first + np.array(left, np.int64), first + np.array([end[i] for i in left], np.int64)


def _search(rows: np.ndarray, wanted: np.ndarray, beyond: bool) -> np.ndarray:
    """For each of ``wanted`` the first of the sorted ``rows`` that is not less (``beyond``: that is greater)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(rows), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        got = rows[np.minimum(middle, len(rows) - 1)]
        less, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for w in range(rows.shape[1]):
            less |= equal & (got[:, w] < wanted[:, w])
            equal &= got[:, w] == wanted[:, w]
        go = (less | equal if beyond else less) & (low < high)
        low, high = np.where(go, middle + 1, low), np.where(go, high, np.minimum(high, middle))
    return low


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True
) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_sha256`` and, on demand, ``ids``.

    ``decoded_sha256``: of the text that the ids decode to, which is the text itself but for U+2581.
    """
    path = model or default_model()
    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path)
        for batch in batches:
            for some in _chunks(batch):
                ids = one.encode([t for _, t in some])
                columns = [
                    [d for d, _ in some],
                    [len(i) // 4 for i in ids],
                    [zlib.crc32(i) for i in ids],
                    [hashlib.sha256(one.decode(i).encode("utf-8", "surrogatepass")).hexdigest() for i in ids],
                    [np.frombuffer(i, "<u4").astype(np.int32) for i in ids] if with_ids else [],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _chunks(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, str | None]]]:
    some, held = [], 0
    for doc, text in zip(batch.column(0), batch.column(1), strict=True):
        some.append((doc.as_py(), text.as_py()))
        held += len(some[-1][1] or "")
        if held >= BATCH_CHARS:
            yield some
            some, held = [], 0
    if some:
        yield some
