"""Secret scan: three patterns, and a ratio of two character Markov models for what they miss.

One first-order Markov model is trained on random strings, the other on ordinary identifiers, which are made of every
word of the whole corpus, as often as it occurs. A token of the text is a
secret if the sum over its character pairs of log P(b | a, random) - log P(b | a, ordinary) exceeds a bound: the
log of ``ODDS``, or what all but ``FALSE`` of the ordinary samples stay below if that is more. Tokens are runs of
``SHORTEST`` or more letters, digits and ``+/_=-`` that touch no other letter. Not scored, because they are no strings
of mixed characters, are words of one case (a first capital aside), numbers with their separators, and UUIDs.

Everything is a DataFrame expression: patterns run as Java regular expressions inside the scan, spans are found with
array functions, and no text is shuffled, only words with their counts. The model is one array of ``SYMBOLS ** 2``
doubles.

Positions count code points; ends are exclusive. Of each kind the matches are leftmost and do not overlap; spans of
kind ``markov`` are added for tokens. Tokens are looked for after the patterns' spans have been blanked, one pattern
after the other, so what stands beside a pattern's span is a token of its own.

Defined results: a null text counts as empty and holds nothing; repeated rows are scanned one by one; whole texts
are scanned, whatever their length; an empty table gives an empty result; other columns pass through, one named
``secret_spans`` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: The least length of a token, the share of ordinary samples that may be held for secrets, and the odds against one.
SHORTEST = 12
FALSE = 0.001
ODDS = 1000
_RUN = "A-Za-z0-9+/_=-"
_UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_PLAIN = rf"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9+/_=-]+|{_UUID})(?![\p{{L}}{_RUN}])"
TOKEN = rf"(?<![\p{{L}}{_RUN}])(?!{_PLAIN})[{_RUN}]{{{SHORTEST},}}+(?!\p{{L}})"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(ALPHABET)
SAMPLE_ROWS = 20_000
#: Pairs of ``IDENTIFIERS`` among the ordinary samples; the weight of all ordinary samples together, at most.
OWN_PAIRS, ORDINARY = 4_000, 64_000
#: Words of identifiers; the corpus adds its own.
IDENTIFIERS = (
    "account action address apply array async auth base batch block body buffer build button byte cache call case chain "
    "change check child class client close code color column command common config connect content context control "
    "convert copy count create current data date debug default delete detail device directory display document domain "
    "edit element enable engine entry error event execute export factory field file filter find flag float format frame "
    "function get global graph group handler hash header height host html icon image import index info init input insert "
    "instance item iterator job json key label last layer length level library limit line link list load local lock log "
    "main manager map match media member memory menu merge message meta method mode model module name network next node "
    "number object offset open option order output owner package page parse password path pattern point pool port "
    "prefix process profile project property provider proxy query queue random range read record register remove render "
    "request reset resource response result return root route row run sample schema scope script search select send "
    "server service session set size sort source start state status store stream string style system table target task "
    "test text thread time title token tool type unit update url user utility value version view web wrapper write"
).split()


_SPANS = "array<struct<start:int,kind:int,end:int>>"


_BLOCK = 256


def _pieces(text: Column, pattern: str, groups: int = 0) -> Column:
    """The text in pieces ``gap, hit`` and, with ``groups`` = 1, ``core``: what precedes a match, the match, its group.

    Anchoring every piece at the end of the one before keeps the search linear.
    """
    whole = F.lit(rf"\G((?s:.*?))(?:({pattern})|\z)")
    parts = [F.regexp_extract_all(text, whole, F.lit(g)) for g in range(1, 3 + groups)]
    return F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("gap", "hit", "core")[: 2 + groups], strict=True)))


def _located(pieces: Column, kind: str, fits: Callable[[Column], Column]) -> Column:
    """Spans of the pieces' hits that fit. Places are counted in blocks of pieces, then block by block: appending to
    one array for each hit would take time with the square of their number."""

    def merge(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        found = F.when(fits(x), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), found.alias("spans"))

    def join(acc: Column, x: Column) -> Column:
        shift = lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end"))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["spans"], F.array(F.transform(x["spans"], shift))).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    number = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(number, lambda b: F.aggregate(F.slice(pieces, b * _BLOCK + 1, F.lit(_BLOCK)), zero, merge))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("spans"))
    return F.flatten(F.aggregate(blocks, start, join, lambda acc: acc["spans"]))


def _spans(text: Column, kind: str, pattern: str, fits: Callable[[Column], Column], hint: str | None = None, groups: int = 0) -> Column:
    """Spans of ``pattern``'s matches. ``hint``: a cheaper pattern found in every text that holds a match."""
    found = common.let(_pieces(text, pattern, groups), lambda p: _located(p, kind, fits))
    return F.when(text.rlike(hint or pattern), found).otherwise(F.array().cast(_SPANS))


def _blanked(text: Column, pattern: str, fits: Callable[[Column], Column], groups: int = 0) -> Column:
    """The text with a blank for every character of the matches that fit."""
    keep = lambda x: F.concat(x["gap"], F.when(fits(x), F.repeat(F.lit(" "), F.char_length(x["hit"]))).otherwise(x["hit"]))
    return F.when(text.rlike(pattern), F.array_join(F.transform(_pieces(text, pattern, groups), keep), "")).otherwise(text)


_PATTERNS: list[tuple[str, str, str, int, Callable[[Column], Column]]] = [
    ("assign", ASSIGN, ASSIGN, 1, lambda x: F.char_length(x["core"]) >= ASSIGN_LEAST),
    ("access", ACCESS, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4}}}", 0, lambda x: F.char_length(x["hit"]) >= ACCESS_LEAST),
    ("hex", rf"[0-9a-f]{{{HEX_LEAST},}}", rf"[0-9a-f]{{{HEX_LEAST}}}", 0, lambda x: F.char_length(x["hit"]) >= HEX_LEAST),
]


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end>>`` of the three patterns, by start, then kind."""
    return F.array_sort(F.concat(*(_spans(text, kind, pattern, fits, hint, groups) for kind, pattern, hint, groups, fits in _PATTERNS)))


def without_base(text: Column) -> Column:
    """The text with the spans of the patterns blanked, one pattern after the other."""
    for _, pattern, _, groups, fits in _PATTERNS:
        text = common.let(text, lambda t, p=pattern, f=fits, g=groups: _blanked(t, p, f, g))
    return text


def random_samples(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``token, random``: strings in the usual alphabets of keys, drawn from a keyed hash so that runs agree."""
    raw = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(raw))
    shape = F.col("id") % 5
    token = (
        F.when(shape == 0, F.substring(raw, 1, 40))
        .when(shape == 1, F.upper(F.substring(F.translate(b64, "+/=", "x7Q"), 1, 20)))
        .when(shape == 2, F.translate(b64, "+/=", "-_"))
        .when(shape == 3, F.regexp_replace(b64, "[+/=]", ""))
        .otherwise(b64)
    )
    return spark.range(rows).select(token.alias("token"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("times"))


def ordinary_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``token, random, times``: identifiers made of two words, and how often they count.

    Every word of every whole text is joined with one of ``IDENTIFIERS``, in the order and form that its hash has, and
    counts as often as it occurs. ``OWN_PAIRS`` pairs of ``IDENTIFIERS``, in all forms, count as much as all of these.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    word = F.explode(F.split(text, r"[^A-Za-z]+")).alias("word")
    cut = docs.select(word).where(F.length("word") >= 2).select(F.substring("word", 1, 16).alias("word"))
    words = common.materialise(cut.groupBy("word").agg(F.count(F.lit(1)).alias("times")), "words")
    known = F.array(*map(F.lit, IDENTIFIERS))
    pick = lambda salt, of: F.get(known, F.pmod(F.xxhash64(F.lit(salt), F.col(of)), F.lit(len(IDENTIFIERS))).cast("int"))
    form = F.pmod(F.xxhash64("word", F.lit("form")), F.lit(8)).cast("int")
    first = (form < 2) | (F.pmod(F.xxhash64("word", F.lit("order")), F.lit(2)) == 0)  # two forms have no second word
    joined = F.when(first, F.array(F.col("word"), pick("b", "word"))).otherwise(F.array(pick("a", "word"), F.col("word")))
    total = words.agg(F.sum("times").alias("n")).first()["n"] or 0
    own = spark.range(OWN_PAIRS).select(F.array(pick("a", "id"), pick("b", "id")).alias("pair"), F.lit(max(1, total // (8 * OWN_PAIRS))).cast("long").alias("times"))
    a, b = (F.get("pair", F.lit(i)) for i in (0, 1))
    n = F.pmod(F.xxhash64("pair"), F.lit(2048)).cast("string")
    made = F.array(
        a,
        F.concat(a, n),
        F.concat(a, F.initcap(b)),
        F.concat(F.initcap(a), F.initcap(b), n),
        F.concat_ws("_", a, b, n),
        F.upper(F.concat_ws("_", a, b)),
        F.concat_ws("-", a, b, F.lit("2024-01-15")),
        F.concat_ws("/", a, b),
    )
    held = words.select(joined.alias("pair"), "times", form.alias("form")).select(F.get(made, F.col("form")).alias("token"), "times")
    tokens = held.union(own.select(F.explode(made).alias("token"), "times"))
    return tokens.select("token", F.lit(False).alias("random"), "times")


def train(samples: DataFrame) -> list[float]:
    """Log ratios of the transitions, ``ALPHABET`` squared, from ``samples(token, random boolean, times long)``.

    Ordinary counts are scaled to ``ORDINARY`` samples if there are more, so that adding one smooths alike for corpora
    of any size. What reaches the driver is bounded by the alphabet: a count for each pair of characters and label.
    """
    total = samples.where(~F.col("random")).agg(F.sum("times").alias("n")).first()["n"] or 0
    weight = {True: 1.0, False: min(1.0, ORDINARY / max(1, total))}
    pairs = (
        samples.where(F.length("token") >= 2)
        .select("random", "token", "times", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
        .groupBy("random", F.substring("token", F.col("i"), F.lit(2)).alias("pair"))
        .agg(F.sum("times").alias("n"))
        .where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
        .collect()
    )
    counts = {flag: [[1] * SYMBOLS for _ in ALPHABET] for flag in (True, False)}
    for r in pairs:
        counts[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["n"] * weight[r["random"]]
    out = []
    for a in range(SYMBOLS):
        totals = {flag: sum(counts[flag][a]) for flag in counts}
        out += [
            math.log(counts[True][a][b] / totals[True]) - math.log(counts[False][a][b] / totals[False])
            for b in range(SYMBOLS)
        ]
    return out


def ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the log ratios of the token's character pairs; the token holds characters of ``ALPHABET`` only."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.get(table, (at(i) - 1) * SYMBOLS + at(i + 1) - 1),
    )


def threshold(samples: DataFrame, ratios: list[float]) -> float:
    """The log of ``ODDS``, or what a share ``FALSE`` of the ordinary samples that are tokens exceeds, if that is more.

    Ratios are rounded up to hundredths and counted, so that few numbers, whatever the corpus, make the percentile.
    """
    tokens = samples.where(~F.col("random") & F.col("token").rlike(rf"^{TOKEN}$"))
    counted = tokens.groupBy((F.ceil(ratio(F.col("token"), ratios) * 100) / 100).alias("x")).agg(F.sum("times").alias("n"))
    x = counted.agg(F.percentile("x", F.lit(1 - FALSE), F.col("n")).alias("x")).first()["x"]
    return max(math.log(ODDS), x if x is not None else 0.0)


def scanned(
    docs: DataFrame,
    samples: DataFrame | None = None,
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` with ``secret_spans``, an ``array<struct<start, kind, end>>`` by start, then kind (index in KINDS)."""
    if samples is None:
        samples = random_samples(docs.sparkSession, sample_rows).union(ordinary_samples(docs, text_col))
    else:
        samples = common.materialise(samples, "secret-samples")
    ratios = train(samples)
    limit = threshold(samples, ratios)
    base, rest = common.unused(docs, "base", "rest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.withColumn(base, base_spans(text))
    held = held.withColumn(rest, F.when(F.size(base) > 0, without_base(text)).otherwise(text))
    tokens = _spans(F.col(rest), "markov", TOKEN, lambda x: F.when(x["hit"] != "", ratio(x["hit"], ratios) > limit).otherwise(False))
    return held.withColumn("secret_spans", F.array_sort(F.concat(base, tokens))).drop(base, rest)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""

    def merge(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        put = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), put.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, merge, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
