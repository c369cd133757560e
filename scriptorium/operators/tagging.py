"""Tag aggregates, tag suggestions and the archive's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(tags: DataFrame, entry_tags: DataFrame) -> DataFrame:
    """``tag, count`` for every tag, also those that no entry has; aggregated before the join."""
    used = entry_tags.groupBy("tag").agg(F.count("entry_id").alias("count"))
    return tags.join(used, "tag", "left").select("tag", F.coalesce("count", F.lit(0)).alias("count")).orderBy(F.desc("count"), "tag")


def popular(entry_tags: DataFrame, limit: int) -> DataFrame:
    return entry_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tag").limit(limit)


def by_domain(entries: DataFrame, entry_tags: DataFrame, domain: str, limit: int) -> DataFrame:
    ids = entries.where(F.col("domain") == domain).select(F.col("id").alias("entry_id"))
    return popular(entry_tags.join(ids, "entry_id", "left_semi"), limit)


def by_entries(ids: DataFrame, entry_tags: DataFrame, limit: int) -> DataFrame:
    """Tags of the entries ``ids(doc_id)``, such as those that a search for a title has found."""
    return popular(entry_tags.join(ids.select(F.col("doc_id").alias("entry_id")), "entry_id", "left_semi"), limit)


def suggestions(domain: DataFrame, similar: DataFrame, everywhere: DataFrame, each: int = 5) -> DataFrame:
    """``kind, tag, count``: tags of the domain, then of similar entries, then popular ones, none of them twice.

    The inputs are ranked lists of at most a few dozen rows.
    """
    top = lambda df: df.orderBy(F.desc("count"), "tag").limit(each)
    first = top(domain)
    second = top(similar.join(first, "tag", "left_anti"))
    third = top(everywhere.join(first, "tag", "left_anti").join(second, "tag", "left_anti"))
    named = [df.select(F.lit(k).alias("kind"), "tag", "count") for k, df in (("domain", first), ("similar", second), ("popular", third))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def stats(entries: DataFrame, now: Column, created: Column, domain: str = "domain") -> DataFrame:
    """One row, one pass: entries, PDFs, articles, distinct domains, entries of the last seven days."""
    return entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("content_type") == "pdf", 1)).alias("pdfs"),
        F.count(F.when(F.col("content_type") == "article", 1)).alias("articles"),
        F.countDistinct(domain).alias("domains"),
        F.count(F.when(created >= now - 7 * 86400, 1)).alias("recent"),
    )
