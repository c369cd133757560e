"""URL filter: host and path rules, then the ratio of two character language models.

One model is trained on accepted URLs, the other on rejected ones. Both are Markov models of variable order
(0 to ``order``) over characters, smoothed by Witten-Bell interpolation: the estimate in a context of n characters
is mixed with that of its n-1 last characters, down to a uniform distribution. A URL's score is the mean over its
characters of log P(accepted) - log P(rejected); the threshold is calibrated on the training URLs. The score is
at or above the threshold: allow, below: block.

Training, calibration and scoring are DataFrame expressions. The alphabet is fixed (letters in lower case, one class
for digits, ASCII punctuation, one class for the rest), so a model has at most 43 ** (order + 1) entries whatever the
input, and its broadcast is bounded: about 80,000 rows at order 2.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is scored by its
characters; an empty URL scores 0; repeated rows are judged one by one; without training URLs of one kind every
score is 0, threshold 0, and what no rule fits is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 2
START = "^"
PUNCTUATION = "-._~:/?#@!$&=+%,;()'*"  # fixed values: the ASCII signs that get symbols of their own
SYMBOLS = 26 + 1 + len(PUNCTUATION) + 2


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


RULES = (
    rule("block", "net/"),
    rule("allow", "example.net/en/"),
    rule("block", "example.com/de/"),
    rule("allow", "org/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The URL over the fixed alphabet: digits become 0, other signs become a blank."""
    kept = "".join("\\" + c for c in PUNCTUATION)
    plain = F.regexp_replace(common.ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.regexp_replace(plain, f"[^a-z0{kept}]", " ")


def _positions(texts: DataFrame, order: int) -> DataFrame:
    """A row for each character: ``ctx`` (the ``order`` symbols before it) and ``ch``. Empty texts give none."""
    text = F.concat(F.lit(START * order), F.col("symbols"))
    return (
        texts.where(F.length("symbols") > 0)
        .select("*", F.explode(F.sequence(F.lit(1), F.length("symbols"))).alias("at"))
        .select(
            *texts.columns,
            F.substring(text, F.col("at"), F.lit(order)).alias("ctx"),
            F.substring(F.col("symbols"), F.col("at"), F.lit(1)).alias("ch"),
        )
    )


def train(samples: DataFrame, order: int = ORDER) -> DataFrame:
    """Both models as counts ``ctx, ch, accepted, rejected`` from ``samples(symbols, accepted boolean, n)``."""
    kind = lambda flag: F.sum(F.when(F.col("accepted") == flag, F.col("n")).otherwise(0))
    return _positions(samples, order).groupBy("ctx", "ch").agg(kind(True).alias("accepted"), kind(False).alias("rejected"))


def _witten_bell(n: str, total: str, kinds: str, lower: str) -> Column:
    """(n + kinds * lower) / (total + kinds); the lower order's estimate where the context was never seen."""
    n_, total_, kinds_ = (F.coalesce(F.col(c), F.lit(0)) for c in (n, total, kinds))
    return F.when(total_ > 0, (n_ + kinds_ * F.col(lower)) / (total_ + kinds_)).otherwise(F.col(lower))


def log_ratios(pairs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``ctx, ch, llr`` for each of ``pairs(ctx, ch)``: log P(ch | ctx) of the accepted less that of the rejected.

    Contexts, characters and so all tables here are bounded by the alphabet, not by the input.
    """
    out = pairs.withColumn("a", F.lit(1.0 / SYMBOLS)).withColumn("r", F.lit(1.0 / SYMBOLS))
    for k in range(order + 1):
        tail = F.substring("ctx", order - k + 1, k)
        counts = model.groupBy(tail.alias("c"), "ch").agg(F.sum("accepted").alias("na"), F.sum("rejected").alias("nr"))
        totals = counts.groupBy("c").agg(
            F.sum("na").alias("ta"),
            F.sum("nr").alias("tr"),
            F.count(F.when(F.col("na") > 0, 1)).alias("ka"),
            F.count(F.when(F.col("nr") > 0, 1)).alias("kr"),
        )
        out = (
            out.withColumn("c", tail)
            .join(F.broadcast(counts), ["c", "ch"], "left")
            .join(F.broadcast(totals), "c", "left")
            .select(
                "ctx",
                "ch",
                _witten_bell("na", "ta", "ka", "a").alias("a"),
                _witten_bell("nr", "tr", "kr", "r").alias("r"),
            )
        )
    return out.select("ctx", "ch", F.log(F.col("a") / F.col("r")).alias("llr"))


def scores(texts: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``symbols, score`` for each of ``texts(symbols)``: the mean log ratio over its characters."""
    at = _positions(texts, order)
    ratios = common.materialise(log_ratios(at.select("ctx", "ch").distinct(), model, order), "url-ratios")
    return at.join(F.broadcast(ratios), ["ctx", "ch"]).groupBy("symbols").agg(F.avg("llr").alias("score"))


def threshold(scored: DataFrame) -> float:
    """From ``scored(score, accepted, n)``: as many standard deviations below the accepted URLs' mean as above the
    rejected ones'; 0 without URLs of either kind."""
    at = {}
    for flag in (True, False):
        w, x = F.when(F.col("accepted") == flag, F.col("n")), F.col("score")
        at[flag] = (F.sum(w), F.sum(w * x), F.sum(w * x * x))
    row = scored.agg(*(c.alias(f"{f}{i}") for f, cs in at.items() for i, c in enumerate(cs))).first()
    if not row["True0"] or not row["False0"]:
        return 0.0
    mean, dev = {}, {}
    for flag in (True, False):
        n, s, q = (row[f"{flag}{i}"] for i in range(3))
        mean[flag] = s / n
        dev[flag] = max(q / n - mean[flag] ** 2, 0.0) ** 0.5 + 1e-9
    return (mean[True] * dev[False] + mean[False] * dev[True]) / (dev[True] + dev[False])


def judged(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    order: int = ORDER,
    url_col: str = "url",
    samples: DataFrame | None = None,
) -> DataFrame:
    """All columns of ``pages`` (those of the same names replaced) and ``host, path, rule, verdict, score``.

    ``samples(url, accepted boolean)``: labelled URLs to train on; without it those that a rule decides.
    """
    spark = pages.sparkSession
    held = pages.drop("host", "path", "rule", "verdict", "score")
    text, fits = common.unused(held, "symbols", "fits")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = held.withColumns({"host": host, "path": path, text: symbols(F.col(url_col))})
    rows = rows.withColumn(fits, matching_rule(F.col("host"), F.col("path"), rules))
    own = F.col(text).alias("symbols")
    if samples is None:
        labelled = rows.where(F.col(fits).isNotNull()).select(own, (F.col(fits)["verdict"] == "allow").alias("accepted"))
    else:
        labelled = samples.select(symbols(F.col("url")).alias("symbols"), "accepted")
    labelled = common.materialise(labelled.groupBy("symbols", "accepted").agg(F.count(F.lit(1)).alias("n")), "url-labelled")
    model = common.materialise(train(labelled, order), "url-model")
    both = model.agg(F.sum("accepted"), F.sum("rejected")).first()
    if both[0] and both[1]:
        texts = rows.select(own).union(labelled.select("symbols")).distinct()
        scored = common.materialise(scores(texts, model, order), "url-scores")
        least = threshold(labelled.join(scored, "symbols"))
    else:
        scored, least = spark.createDataFrame([], "symbols string, score double"), 0.0
    out = rows.join(scored.withColumnRenamed("symbols", text), text, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select(
        *held.columns,
        "host",
        "path",
        F.col(fits)["rule"].alias("rule"),
        F.coalesce(F.col(fits)["verdict"], F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"),
        "score",
    )
