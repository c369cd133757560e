"""Derived rows of entries that have none yet: chunks, vectors and keywords; replacing those of given entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, keywords
from .listing import missing
from .vectors import Provider, embedded

LEAST_BYTES, CHUNK_CHARS = 50, 2500


def titled_texts(entries: DataFrame, content: DataFrame) -> DataFrame:
    """``id, title, extracted_text`` of entries with a text."""
    texts = content.select(F.col("entry_id").alias("id"), F.coalesce("extracted_text", F.lit("")).alias("extracted_text"))
    return entries.select("id", F.coalesce("title", F.lit("")).alias("title")).join(texts, "id")


def missing_chunks(entries: DataFrame, content: DataFrame, held: DataFrame, provider: Provider) -> DataFrame:
    """``entry_id, chunk_index, chunk_text, embedding, model_version`` for entries without chunks. A chunk is embedded
    behind its entry's title."""
    rows = titled_texts(missing(entries, held), content)
    cut = chunks.chunked(rows.select(F.col("id").alias("entry_id"), "extracted_text"))
    texts = cut.join(rows.select(F.col("id").alias("entry_id"), "title"), "entry_id")
    text = F.left(F.concat("title", F.lit(": "), "chunk_text"), F.lit(CHUNK_CHARS))
    return embedded(texts.withColumn("_text", text), provider, "_text").drop("_text", "title")


def missing_vectors(entries: DataFrame, content: DataFrame, held: DataFrame, provider: Provider) -> DataFrame:
    """``entry_id, embedding, model_version`` for entries without a vector, of title and text; short texts have none."""
    rows = titled_texts(missing(entries, held), content).where(F.octet_length("extracted_text") >= LEAST_BYTES)
    text = F.concat("title", F.lit("\n\n"), "extracted_text")
    return embedded(rows.select(F.col("id").alias("entry_id"), text.alias("_text")), provider, "_text").drop("_text")


def missing_keywords(entries: DataFrame, content: DataFrame, held: DataFrame, count: int = 10) -> DataFrame:
    """``entry_id, keyword, score`` for entries without keywords."""
    return keywords.entry_keywords(titled_texts(missing(entries, held), content), count)


def replaced(held: DataFrame, rows: DataFrame, key: str = "entry_id") -> DataFrame:
    """A derived table with the rows of some entries in place of those that it had."""
    return held.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def of_entry(held: DataFrame, entry_id: object) -> DataFrame:
    """An entry's keywords, the best first."""
    return held.where(F.col("entry_id") == F.lit(entry_id)).orderBy("score", "keyword")
