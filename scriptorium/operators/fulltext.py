"""Full-text search: an inverted index in files, phrases and prefixes, BM25 with column weights, snippets.

The index holds a row for each (term, document, column) with its positions. It is written in segments. A document's
words are grouped where it is read, and each task writes its documents' rows as a run sorted by term, so nothing is
shuffled; of every run a query reads only the pages whose bounds hold its terms, prefixes included. Documents are added as
new segments; removing or replacing one writes its id to a small table of removals that readers subtract, and a rebuild
writes one segment anew.

Scores are BM25 with k1 = 1.2 and b = 0.75; the frequency of a phrase is the sum of its hits weighted by column, a
document's length is the number of tokens of both columns, and a document must hold every phrase. The same functions
score a DataFrame of tokenised documents, one scan a query, where there is no index.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stemming import stem, stem_column
from ..session import scratch

K1, B = 1.2, 0.75
WEIGHTS = {"title": 5.0, "body": 1.0}
LONGEST_QUERY = 1000


_FOLDED = str.maketrans(X.ACCENTED, X.PLAIN)


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False


def fold(word: str) -> list[str]:
    plain = word.lower().translate(_FOLDED)
    return [w for w in re.split(r"[^\w]+|_", plain) if w]


def parse(query: str, stemmed: bool = False) -> list[Phrase]:
    """Each word is a phrase of its tokens; the last word, and any that ends in ``*``, matches as a prefix.

    Quotes and backslashes are dropped; a last word of nothing else still is the last. Empty or too long queries are
    errors; a query of signs alone has no phrases and finds nothing. ``stemmed``: tokens become their stems.
    """
    if not query.strip() or len(query.encode()) > LONGEST_QUERY:
        raise ValueError("a query has 1 to 1000 bytes")
    words = query.split()
    out = []
    for n, word in enumerate(words):
        word = word.replace('"', "").replace("\\", "")
        tokens = tuple(stem(t) for t in fold(word)) if stemmed else tuple(fold(word))
        if tokens:
            out.append(Phrase(tokens, word.endswith("*") or n == len(words) - 1))
    return out


def documents(content: DataFrame, stemmed: bool = False, id_col: str = "doc_id", title: Column | None = None, text_col: str = "text") -> DataFrame:
    """``doc_id, title, body`` as arrays of terms."""
    title = X.first_line(text_col) if title is None else title
    terms: Callable[[Column], Column] = (lambda c: stem_column(X.tokens(c))) if stemmed else X.tokens
    return content.select(F.col(id_col).alias("doc_id"), terms(title).alias("title"), terms(F.col(text_col)).alias("body"))


def _groups(ids: pa.Array, columns: list[pa.Array], own: bool) -> pa.RecordBatch:
    """The postings of some documents, sorted by term: words are numbered in order, and runs of equal numbers cut."""
    n, names = len(ids), list(WEIGHTS)
    sizes = np.array([pc.fill_null(pc.list_value_length(c), 0).to_numpy() for c in columns], np.int64).reshape(len(names), n)
    words = pa.chunked_array([c.flatten() for c in columns], pa.string()).combine_chunks().dictionary_encode()
    alphabet = pc.sort_indices(words.dictionary)
    place = np.empty(len(alphabet), np.int64)
    place[alphabet.to_numpy()] = np.arange(len(alphabet))
    each = sizes.ravel()
    slot = np.repeat(np.arange(len(each)), each)  # the column and document of each word
    position = np.arange(len(slot)) - np.repeat(np.cumsum(each) - each, each)
    key = (place[words.indices.to_numpy()] * n + slot % n) * len(names) + slot // n
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    cut, doc = key[begin] // len(names), (key[begin] // len(names)) % n
    terms = words.dictionary.take(alphabet.take(pa.array(cut // n)))
    column = pa.array(names, pa.string()).take(pa.array(key[begin] % len(names)))
    lists, starts = position[order].astype(np.int32), begin
    if own:
        terms, column = (pa.concat_arrays([pa.array([""] * n, pa.string()), x]) for x in (terms, column))
        doc, starts = np.concatenate([np.arange(n), doc]), np.concatenate([np.zeros(n, np.int64), begin])
    held = pa.ListArray.from_arrays(pa.array(np.append(starts, len(lists)), pa.int32()), pa.array(lists, pa.int32()))
    return pa.RecordBatch.from_arrays([terms, ids.take(pa.array(doc)), column, held, pa.array(sizes.sum(0)[doc], pa.int64())], ["term", "doc_id", "column", "positions", "length"])


#: Documents whose words are grouped at once, and rows that leave in one batch.
GROUPED, BATCH_ROWS = 1024, 65536


def postings(docs: DataFrame, own: bool = False) -> DataFrame:
    """``term, doc_id, column, positions, length`` (tokens of the document's two columns).

    ``own``: a row more for each document, with an empty term and its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUPED):
                part = batch.slice(at, GROUPED)
                rows = _groups(part.column(0), [part.column(i + 1) for i in range(len(WEIGHTS))], own)
                for first in range(0, rows.num_rows, BATCH_ROWS):
                    yield rows.slice(first, BATCH_ROWS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *WEIGHTS).mapInArrow(run, f"term string, doc_id {kind}, column string, positions array<int>, length long")


def _follows(k: int) -> Callable[[Column], Column]:
    return lambda p: F.array_contains(f"p{k}", p + k)


def _all_of(tests: list[Callable[[Column], Column]]) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda a, b: a & b, [t(x) for t in tests], F.lit(True))


class TextIndex:
    """An index under one folder; ``docs`` everywhere are ``doc_id, title, body`` as :func:`documents` gives them."""

    def __init__(self, spark: SparkSession, root: str | None = None, stemmed: bool = False):
        self.spark, self.root, self.stemmed = spark, root or scratch(spark, "text-index"), stemmed
        #: Paths in the order of writing, and whether they hold a segment or removals.
        self.parts: list[tuple[bool, str]] = []

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> TextIndex:
        """An index that was written before: its last manifest says what it holds."""
        rows = spark.read.parquet(f"{root}/manifest").collect()  # a row for each change
        out = cls(spark, root, rows[0]["stemmed"])
        last = max(r["version"] for r in rows)
        out.parts = [(r["segment"], f"{root}/{r['name']}") for r in sorted(rows, key=lambda r: r["n"]) if r["version"] == last and r["name"]]
        return out

    def _add(self, segment: bool, path: str) -> None:
        self.parts.append((segment, path))
        self._record()

    def _record(self) -> None:
        version = getattr(self, "version", 0) + 1
        rows = [(version, n, s, p.removeprefix(f"{self.root}/"), self.stemmed) for n, (s, p) in enumerate(self.parts)]
        rows = rows or [(version, 0, False, "", self.stemmed)]
        frame = self.spark.createDataFrame(rows, "version int, n int, segment boolean, name string, stemmed boolean")
        frame.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        self.version = version

    def add(self, docs: DataFrame) -> int:
        """Writes the documents as a new segment and returns how many they are."""
        path = f"{self.root}/segment-{len(self.parts)}-{uuid.uuid4().hex[:8]}"
        postings(docs, own=True).sortWithinPartitions("term", "doc_id").write.parquet(path)
        self._add(True, path)
        return self.spark.read.parquet(path).where("term = ''").count()

    def remove(self, ids: DataFrame) -> None:
        """The documents ``ids(doc_id)`` are no longer found, unless they are added again."""
        path = f"{self.root}/removed-{len(self.parts)}-{uuid.uuid4().hex[:8]}"
        ids.select("doc_id").distinct().write.parquet(path)
        self._add(False, path)

    def replace(self, docs: DataFrame) -> int:
        """Documents are indexed anew, whether they were there or not."""
        self.remove(docs)
        return self.add(docs)

    def rebuild(self, docs: DataFrame) -> int:
        """One segment of ``docs`` in place of all that there is; returns how many documents it holds."""
        self.parts = []
        return self.add(docs)

    def _live(self, condition: Column) -> DataFrame | None:
        """Rows of all segments without those of documents removed later."""
        out = None
        for n, (segment, path) in enumerate(self.parts):
            if not segment:
                continue
            rows = self.spark.read.parquet(path).where(condition)
            for later, gone in self.parts[n + 1 :]:
                if not later:
                    rows = rows.join(self.spark.read.parquet(gone), "doc_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def postings(self, token: str | None = None, prefix: bool = False) -> DataFrame:
        """``term, doc_id, column, positions, length`` of a term, of the terms with a prefix, or of all."""
        rows = self._live(F.col("term") != "" if token is None else _is_term(F.col("term"), token, prefix))
        return rows if rows is not None else self.spark.createDataFrame([], "term string, doc_id long, column string, positions array<int>, length long")

    def corpus_size(self) -> tuple[int, float]:
        rows = self._live(F.col("term") == "")  # a row for each document
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("l")).first() if rows is not None else None
        return (r["n"], r["l"] or 1.0) if r else (0, 1.0)

    def hits(self, phrases: list[Phrase], weights: dict[str, float] = WEIGHTS) -> DataFrame:
        """``doc_id, length, f0, f1 …``, as :func:`hits` of documents: only postings of the phrases' terms are read."""
        parts = []
        weight = reduce(lambda a, kv: F.when(F.col("column") == kv[0], F.lit(float(kv[1]))).otherwise(a), weights.items(), F.lit(0.0))
        for n, phrase in enumerate(phrases):
            if len(phrase.tokens) == 1:  # no positions to compare: the rows are summed as they are
                held = self.postings(phrase.tokens[0], phrase.prefix)
                parts.append(held.select("doc_id", "length", F.lit(n).alias("phrase"), (F.size("positions") * weight).alias("f")))
                continue
            places = None
            for k, token in enumerate(phrase.tokens):
                prefix = phrase.prefix and k == len(phrase.tokens) - 1
                held = self.postings(token, prefix).groupBy("doc_id", "column").agg(F.flatten(F.collect_list("positions")).alias(f"p{k}"), F.max("length").alias(f"l{k}"))
                places = held if places is None else places.join(held, ["doc_id", "column"])
            follows = [_follows(k) for k in range(1, len(phrase.tokens))]
            after = _all_of(follows)
            parts.append(places.select("doc_id", F.col("l0").alias("length"), F.lit(n).alias("phrase"), (F.size(F.filter("p0", after)) * weight).alias("f")))
        found = reduce(DataFrame.unionByName, parts).where("f > 0")
        sums = [F.coalesce(F.sum(F.when(F.col("phrase") == n, F.col("f"))), F.lit(0.0)).alias(f"f{n}") for n in range(len(phrases))]
        return found.groupBy("doc_id").agg(F.max("length").alias("length"), *sums)


def corpus_size(docs: DataFrame | TextIndex) -> tuple[int, float]:
    """Documents and their mean length: one row."""
    if isinstance(docs, TextIndex):
        return docs.corpus_size()
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.size("title") + F.size("body")).cast("double")).alias("l")).first()
    return r["n"], r["l"] or 1.0


def _is_term(col: Column, token: str, prefix: bool) -> Column:
    return col.startswith(token) if prefix else col == token


def _phrase_hits(phrase: Phrase, terms: str) -> Column:
    """Hits of a phrase in an array of terms."""
    n = len(phrase.tokens)
    array = F.col(terms)
    if n == 1:
        return F.size(F.filter(array, lambda t: _is_term(t, phrase.tokens[0], phrase.prefix)))
    at = F.transform(array, lambda t, i: F.slice(array, i + 1, n))
    same = lambda part: reduce(
        lambda a, b: a & b, [_is_term(F.get(part, k), w, phrase.prefix and k == n - 1) for k, w in enumerate(phrase.tokens)]
    )
    return F.size(F.filter(at, lambda part: F.coalesce(same(part), F.lit(False))))


def hits(docs: DataFrame | TextIndex, phrases: list[Phrase], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``doc_id, length, f0, f1 …`` of documents that hold a phrase: its weighted frequencies. One scan, no shuffle."""
    if isinstance(docs, TextIndex):
        return docs.hits(phrases, weights)
    frequencies = [sum((_phrase_hits(p, c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0)).alias(f"f{i}") for i, p in enumerate(phrases)]
    found = docs.select("doc_id", (F.size("title") + F.size("body")).alias("length"), *frequencies)
    return found.where(reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(phrases))]))


def bm25(docs: DataFrame | TextIndex, phrases: list[Phrase], weights: dict[str, float] = WEIGHTS, every: bool = True) -> DataFrame:
    """``doc_id, score`` of the documents that hold every phrase (or any). The figures of a phrase cover all documents."""
    if not phrases:
        return _session(docs).createDataFrame([], "doc_id long, score double")
    n, mean = corpus_size(docs)
    found = hits(docs, phrases, weights)
    names = [f"f{i}" for i in range(len(phrases))]
    holding = found.agg(*(F.count(F.when(F.col(f) > 0, 1)).alias(f) for f in names)).first()
    return found.where(reduce(lambda a, b: a & b, [F.col(f) > 0 for f in names]) if every else F.lit(True)).select(
        "doc_id", _score(names, [idf(n, holding[f]) for f in names], mean).alias("score")
    )


def idf(n: int, holding: int) -> float:
    import math

    return max(math.log((n - holding + 0.5) / (holding + 0.5)), 1e-6)


def _score(names: list[str], idfs: list[float], mean: float) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean))
    return sum((F.lit(w) * F.col(f) * F.lit(K1 + 1) / (F.col(f) + norm) for f, w in zip(names, idfs, strict=True)), F.lit(0.0))


def _session(docs: DataFrame | TextIndex) -> SparkSession:
    return docs.spark if isinstance(docs, TextIndex) else docs.sparkSession


def search(docs: DataFrame | TextIndex, query: str, limit: int = 50, offset: int = 0, stemmed: bool = False) -> DataFrame:
    """The page of ``doc_id, score`` that the query finds, best first."""
    limit, offset = min(max(limit, 1), 1000), max(offset, 0)
    return bm25(docs, parse(query, stemmed)).orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


def search_entries(index: TextIndex, query: str, entries: DataFrame, content: DataFrame, entry_tags: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page of entries that the query finds, with ``score``, ``tags`` and ``snippet``.

    Hits whose entry is gone are dropped. Texts are read for the page's rows only.
    """
    phrases = parse(query, index.stemmed)
    found = bm25(index, phrases).withColumn("score", F.round("score", 6)).withColumnRenamed("doc_id", "id")
    page = found.join(entries, "id").orderBy(F.desc("score"), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 1000))
    tags = entry_tags.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    texts = content.select(F.col("entry_id").alias("id"), "extracted_text")
    out = page.join(tags, "id", "left").join(texts, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    terms = [(t, p.prefix and k == len(p.tokens) - 1) for p in phrases for k, t in enumerate(p.tokens)]
    return out.withColumn("snippet", snippet(F.coalesce("extracted_text", F.lit("")), terms, stemmed=index.stemmed)).drop("extracted_text")


def total(docs: DataFrame | TextIndex, query: str, stemmed: bool = False) -> DataFrame:
    """One row ``total``: the documents that hold every phrase."""
    phrases = parse(query, stemmed)
    if not phrases:
        return _session(docs).range(1).select(F.lit(0).cast("long").alias("total"))
    found = hits(docs, phrases).where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(phrases))]))
    return found.agg(F.count(F.lit(1)).alias("total"))


def matched_page(pages: DataFrame, query: str) -> DataFrame:
    """``entry_id, page_num``: the first page whose text holds the query's first word, in any case."""
    word = (query.split() or [""])[0].lower()
    found = pages.where(F.lower("text").contains(word)) if word else pages.limit(0)
    return found.groupBy("entry_id").agg(F.min("page_num").alias("page_num"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``term, docs, hits``."""
    words = docs.select("doc_id", F.explode(F.concat("title", "body")).alias("term"))
    per_doc = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("hits"))


def snippet(text: Column, terms: list[str] | list[tuple[str, bool]], size: int = 40, left: str = "<mark>", right: str = "</mark>", more: str = "...", stemmed: bool = False) -> Column:
    """``size`` words from the first that holds a term (or the start), with the terms marked. A term may be a prefix."""
    words = X.words(text)
    pairs = [t if isinstance(t, tuple) else (t, False) for t in terms]
    if stemmed:
        # Stems are made of the whole text at once: those of the words, in their order, each a list of its tokens.
        return _stemmed_snippet(text, pairs, size, left, right, more)
    one = lambda tokens, t, prefix: F.exists(tokens, lambda w: w.startswith(t) if prefix else w == t)
    held = lambda w: reduce(lambda a, b: a | b, [one(X.tokens(w), t, prefix) for t, prefix in pairs], F.lit(False))
    at = F.array_min(F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: held(s["w"])), lambda s: s["i"]))
    start = F.coalesce(at, F.lit(0))
    shown = F.transform(F.slice(words, start + 1, size), lambda w: F.when(held(w), F.concat(F.lit(left), w, F.lit(right))).otherwise(w))
    return F.concat(F.when(start > 0, more).otherwise(""), F.array_join(shown, " "), F.when(F.size(words) > start + size, more).otherwise(""))


def _stemmed_snippet(text: Column, pairs: list[tuple[str, bool]], size: int, left: str, right: str, more: str) -> Column:
    """The same by stems, in a vectorised function."""
    blanks = re.compile(r"[\s\x85\x1c-\x1f]+")

    def held(word: str) -> bool:
        stems = [stem(t) for t in fold(word)]
        return any(s.startswith(t) if prefix else s == t for s in stems for t, prefix in pairs)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            words = [w for w in blanks.split(value or "") if w]
            start = next((i for i, w in enumerate(words) if held(w)), 0)
            shown = " ".join(left + w + right if held(w) else w for w in words[start : start + size])
            out.append(more * (start > 0) + shown + more * (len(words) > start + size))
        return pd.Series(out, dtype="object")

    return run(text)
