"""Keywords of single documents by YAKE (Campos et al. 2020), and keywords of sets of entries."""

from __future__ import annotations

import re
import statistics
from collections import Counter
from math import isqrt, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

LEAST_BYTES = 50
# English stop words.
STOP_WORDS = frozenset(
    "a about above after again all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers him his how "
    "i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she "
    "should so some such than that the their them then there these they this those through to too under until up very "
    "was we were what when where which while who whom why will with would you your".split()
)


WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
SENTENCE_END = re.compile(r"[.!?\n]+")


def _usable(w: str) -> bool:
    return len(w) > 1 and w not in STOP_WORDS and not w.isdigit()


def _deviation(counts: np.ndarray) -> float:
    """The population's standard deviation of whole numbers, rounded once."""
    n, total = len(counts), int(counts.sum())
    over, under = n * int((counts * counts).sum()) - total * total, n * n
    shift = max(0, (under.bit_length() - over.bit_length() + 109 + 1) // 2 + 1)
    root = isqrt((over << 2 * shift) // under)
    return (root | (root * root * under != over << 2 * shift)) / (1 << shift)


def extract(text: str, count: int = 10, longest: int = 3, window: int = 1, alike: float = 0.9) -> list[tuple[str, float]]:
    """(keyword, score) with the lowest scores first; texts below 50 bytes have none.

    A text's words are numbered, and pairs and sequences of numbers are counted and scored as arrays.
    """
    if len(text.encode("utf-8", "surrogatepass")) < LEAST_BYTES:
        return []
    sentences = [words for words in map(WORD.findall, SENTENCE_END.split(text)) if words]
    lengths = [len(words) for words in sentences]
    words = [w for words in sentences for w in words]
    low = [w.lower() for w in words]
    known = {w: i for i, w in enumerate(dict.fromkeys(low))}
    names, v = list(known), len(known)
    usable, stop = np.array([_usable(w) for w in names], bool), np.array([w in STOP_WORDS for w in names], bool)
    if not usable.any():
        return []
    ids = np.fromiter(map(known.__getitem__, low), np.int64, len(low))
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    firsts = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    seen = np.bincount(ids, minlength=v)
    capital, acronym = np.zeros(v), np.zeros(v)
    for i, word in enumerate(words):
        if not word.islower():
            capital[ids[i]] += not firsts[i] and word[:1].isupper()
            acronym[ids[i]] += len(word) > 1 and word.isupper()
    # Sentences of each word, in order: their median, and how many there are.
    order = np.argsort(ids, kind="stable")
    at, begin = sentence[order], np.cumsum(seen) - seen
    high, even = at[begin + seen // 2], seen % 2 == 0
    median = np.where(even, (at[begin + np.maximum(seen // 2 - 1, 0)] + high) / 2, high)
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (ids[order][1:] != ids[order][:-1])])
    spots = np.bincount(ids[order][fresh], minlength=v)
    # Pairs of words within the window, by code: the different neighbours on either side and all of them.
    behind = lambda d: np.flatnonzero(sentence[d:] == sentence[: len(ids) - d])  # noqa: E731  where d more words follow
    near = [ids[k] * v + ids[k + d] for d in range(1, window + 1) if len(k := behind(d))]
    pairs, held = np.unique(np.concatenate(near), return_counts=True) if near else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    variety = [np.bincount(w, minlength=v) / np.maximum(1, np.bincount(w, held, v)) for w in (pairs % v, pairs // v)]
    logs = lambda x: np.array([log(y) for y in x.tolist()])
    mean, spread, top = statistics.fmean(seen[usable].tolist()), _deviation(seen[usable]), int(seen.max())
    case = np.maximum(capital, acronym) / (1 + logs(seen))
    place = np.maximum(logs(logs(3 + median) + 1e-12), 0.05)
    related = 1 + (variety[0] + variety[1]) * seen / top
    weight = np.maximum(related * place / (case + seen / (mean + spread) / related + spots / len(lengths) / related), 1e-9)

    own = np.flatnonzero(usable)
    scores, grams = [weight[own] / (seen[own] * (1 + weight[own]))], [[own]]
    codes = ids
    for size in range(2, longest + 1):  # a sequence's code: the place of its beginning among the different ones, its last word
        k = behind(size - 1)
        if not len(k):
            break
        begun = np.unique(codes, return_inverse=True)[1]
        codes = np.full(len(ids), -1)
        codes[k] = begun[k] * v + ids[k + size - 1]
        _, where, tf = np.unique(codes[k], return_index=True, return_counts=True)
        gram = [ids[k[where] + n] for n in range(size)]
        kept = usable[gram[0]] & usable[gram[-1]]
        gram, tf = [w[kept] for w in gram], tf[kept]
        product, total = np.ones(len(tf)), np.zeros(len(tf))
        for n, w in enumerate(gram):
            follow, sums = product * weight[w], total + weight[w]
            if 0 < n < size - 1 and (m := stop[w]).any():  # a stop word counts by how firmly its neighbours stand together
                before, after = gram[n - 1][m], gram[n + 1][m]
                stands = lambda a, b: held[np.searchsorted(pairs, a * v + b)]
                share = stands(w[m], after) / seen[w[m]] * stands(before, w[m]) / seen[before]
                follow[m], sums[m] = product[m] * (1 + 1 - share), total[m] - (1 - share)
            product, total = follow, sums
        scores.append(np.where(total > -1, product / np.where(total > -1, tf * (1 + total), 1), product))
        grams.append(gram)
    score = np.concatenate(scores)
    sizes = np.cumsum([0, *map(len, scores)])
    spelled = lambda x: " ".join(names[w[x - sizes[n]]] for n in [np.searchsorted(sizes, x, "right") - 1] for w in grams[n])
    out: list[tuple[str, float]] = []
    best = np.argsort(score, kind="stable")
    ranked, x = score[best].tolist(), 0
    while x < len(ranked) and len(out) < count:
        end = x + 1
        while end < len(ranked) and ranked[end] == ranked[x]:
            end += 1
        for word in sorted(map(spelled, best[x:end])):
            if len(out) < count and not any(_alike(word, other, alike) for other, _ in out):
                out.append((word, ranked[x]))
        x = end
    return out


def _alike(a: str, b: str, above: float) -> bool:
    """Whether the similarity is over ``above``; most pairs are told apart by their lengths or letters."""
    size = max(len(a), len(b))
    if a == b or size == 0:
        return a == b and above < 1
    one, other = Counter(a), Counter(b)
    least = max((one - other).total(), (other - one).total())  # as many edits at least
    return 1 - least / size > above and _similar(a, b) > above


def _similar(a: str, b: str) -> float:
    """1 less the edit distance as a share of the longer word."""
    if abs(len(a) - len(b)) > 0.1 * max(len(a), len(b)):
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def keywords_column(text: Column, count: int = 10) -> Column:
    """``array<struct<keyword, score>>``."""

    @F.pandas_udf("array<struct<keyword:string,score:double>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"keyword": k, "score": s} for k, s in extract(t or "", count)])

    return run(text)


def entry_keywords(entries: DataFrame, count: int = 10) -> DataFrame:
    """``entry_id, keyword, score`` of ``entries(id, title, extracted_text)``, from the title and the text."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("extracted_text", F.lit("")))
    rows = spread(entries.select(F.col("id").alias("entry_id"), text.alias("_text")))
    return rows.select("entry_id", F.inline(keywords_column(F.col("_text"), count)))


def top_keywords(keywords: DataFrame, limit: int, group: str | None = None) -> DataFrame:
    """``keyword, count, best``: the most frequent keywords, of equals that with the lowest score; by ``group``."""
    keys = [group, "keyword"] if group else ["keyword"]
    counted = keywords.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("score").alias("best"))
    if group is None:
        return counted.orderBy(F.desc("count"), "best", "keyword").limit(limit)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), "best", "keyword"))
    return counted.withColumn("n", rank).where(F.col("n") <= limit)
