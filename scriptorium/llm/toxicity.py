"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the hashes of its words and their stems (the first bytes of a word), of its pairs of
neighbouring words and of its pairs with one word between them; a feature's value grows with the logarithm of its
count. FTRL-proximal keeps a learning rate for every coordinate, and its L1 term leaves
nearly all weights at exactly 0: what is broadcast are the other ones, at most ``2 ** BITS``.

The classifier is fitted in one task on a bounded sample of the labelled rows: those whose hashed ids lie below one
limit for both labels, so that a table of any size is learned at its own rate of toxic rows. The limit leaves
``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` bytes of text on average. A fifth of the sample is not learned from but places
the bound of the score: at 0.5 a share of at most ``FALSE_ALARMS`` of its clean rows is held to be toxic, and where the
two labels are farther apart than that, the bound is halfway between them. Scoring reads every text whole, in a
vectorised function without a shuffle.

Defined results: a null text counts as empty; an empty text is scored by the intercept alone; without labelled rows
every score is 0; documents without a label are scored like others and never trained on; a label that is neither 0
nor 1, or null, is ignored; ids labelled twice count as toxic if one label says so; a null id counts as the empty
text for the fold; repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
TRAIN_ROWS = 24_000
TRAIN_BYTES = 48 << 20
EPOCHS = 3
STEM = 6
#: Of the rows that place the bound: the share of clean ones above it, and of toxic ones below it where there is room.
FALSE_ALARMS, MISSED = 0.01, 0.02
FOLDS = 5

_WORD_SIGNS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def features(text: str | None) -> np.ndarray:
    """Hashes, repeats included, below ``2 ** BITS``."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_WORD_SIGNS).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) * _MIX[0]
    h ^= h >> np.uint64(29)
    stems = np.fromiter((crc32(w[:STEM]) for w in words), np.uint64, len(words)) * _MIX[3]
    parts = [h * _MIX[1], stems ^ (stems >> np.uint64(31)), h[:-1] * _MIX[1] + h[1:] * _MIX[2] + np.uint64(1), h[:-2] * _MIX[1] + h[2:] * _MIX[3] + np.uint64(2)]
    x = np.concatenate(parts)
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features, the intercept last, and their values: log2 of one more than the count."""
    at, times = np.unique(features(text), return_counts=True)
    values = np.append(np.log2(1.0 + times), 1.0).astype(np.float32)
    return np.append(at.astype(np.int32), np.int32(1 << BITS)), values


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def margins(self) -> Callable[[str | None], float]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.index] = self.weight

        def margin(text: str | None) -> float:
            found = features(text)
            found, times = np.unique(found[dense[found] != 0], return_counts=True)
            return self.intercept + float(dense[found] @ np.log2(1.0 + times))

        return margin

    def scorer(self) -> Callable[[str | None], float]:
        margin = self.margins()

        def score(text: str | None) -> float:
            x = margin(text)
            return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x)) if x > -700 else 0.0

        return score


class Ftrl:
    """McMahan et al. 2013, algorithm 1. The intercept has no L1 term."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        size = (1 << BITS) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == 1 << BITS, 0.0, self.l1), 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        at = np.flatnonzero(self.z)
        w = self.weights(at)
        at, w = at[w != 0], w[w != 0]
        bias = w[at == 1 << BITS]
        inner = at < 1 << BITS
        return Model(at[inner].astype(np.int32), w[inner].astype(np.float32), float(bias[0]) if len(bias) else 0.0)


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Visits the rows in the given order, ``epochs`` times."""
    if not texts:
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), -math.inf)
    rows = [counted(t) for t in texts]
    learner = Ftrl()
    for _ in range(epochs):
        for (at, x), label in zip(rows, labels, strict=True):
            learner.learn(at, x, label)
    return learner.model()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by ``FOLDS``: never a row to learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, epochs: int = EPOCHS) -> Model:
    """From ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc_id"))
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(common.lowest(F.col("turn"), share))
    sample = (
        docs.select(F.col("doc_id").alias("_id"), "text")
        .join(F.broadcast(known), F.col("_id") == F.col("doc_id"))  # ``rows`` rows on average
        .groupBy("doc_id")
        .agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"), F.max("turn").alias("turn"))
    )
    sample = common.materialise(sample, "toxicity-sample")
    held = sample.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"]
    if held is None:  # no labelled rows
        return fit([], [])
    sample = sample.where(common.lowest(F.col("turn"), share * min(1.0, size / max(1, held))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for model in fit_frames(list(batches), epochs):
            yield pd.DataFrame({"index": [model.index], "weight": [model.weight], "intercept": [model.intercept]})

    out = sample.coalesce(1).mapInPandas(run, "index array<int>, weight array<float>, intercept double").first()
    if out is None:
        return fit([], [])
    return Model(np.array(out["index"], np.int32), np.array(out["weight"], np.float32), out["intercept"])


def fit_frames(frames: list[pd.DataFrame], epochs: int) -> Iterator[Model]:
    """One model of the frames' rows (``doc_id, text, toxic, turn``), its bound placed; none without rows."""
    rows = pd.concat(frames).sort_values(["turn", "doc_id"], kind="stable") if frames else pd.DataFrame()
    if rows.empty:
        return
    aside = np.array([crc32(f"bound {i}".encode()) % FOLDS == 0 for i in rows["doc_id"]])
    if aside.all():
        aside[:] = False
    model = fit(rows["text"][~aside].tolist(), rows["toxic"][~aside].tolist(), epochs)
    margin = model.margins()
    found = np.array([margin(t) for t in rows["text"][aside]], np.float64)
    labels = rows["toxic"][aside].to_numpy()
    model.intercept -= bound(found[labels == 0], found[labels == 1])
    yield model


def bound(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The margin from which a text is held to be toxic, from those of rows that were not learned from."""
    if not len(clean) or not len(toxic):
        return 0.0
    least = float(np.quantile(clean, 1 - FALSE_ALARMS, method="higher"))
    most = float(np.quantile(toxic, MISSED, method="lower"))
    return (least + most) / 2 if least < most else float(np.nextafter(least, math.inf))


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score of a text, 0 to 1; at 0.5 or more the text is held to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score(F.col(text_col).cast("string"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (columns of those names are replaced)."""
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return docs.withColumns({"held_out": held_out(F.col(id_col)), "score": score_column(docs, model, text_col)}).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
