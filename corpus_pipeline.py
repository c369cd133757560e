"""From raw documents to packed training sequences, in stages that can run and be judged one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from scriptorium.llm import common, exact_dedup, near_copies, packing, secret_scan, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not hold to be toxic.

    A null text counts as empty; repeated rows go or stay together; without labelled rows all stay.
    """
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    (score,) = common.unused(docs, "score")
    scored = docs.withColumn(score, toxicity.score_column(docs, toxicity.train(docs, labels)))
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest, then the one with the least id.

    Null texts equal empty ones; of repeated rows one stays.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of texts whose five-word shingles are alike by 0.8 (Jaccard), the document with the least id.

    SimHash finds the closest, prefix filtering the rest. Null and empty texts are copies of one another; of repeated
    rows one stays.
    """
    return near_copies.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and ``n_chars``, if there is one, counted anew where there was a secret.

    Null texts stay null; repeated rows are all kept.
    """
    (aside,) = common.unused(docs, "aside")  # a column of the input that has the name of the result
    found = secret_scan.scanned(docs.withColumnRenamed("secret_spans", aside))
    spans = F.col("secret_spans")
    hit = F.size(spans) > 0
    masked = F.when(hit, secret_scan.redacted(F.coalesce("text", F.lit("")), spans)).otherwise(F.col("text"))
    out = found.withColumn("text", masked)
    if "n_chars" in docs.columns:
        counted = F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", counted)
    return out.drop("secret_spans").withColumnRenamed(aside, "secret_spans").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in training sequences; a null text is the end id alone."""
    return packing.packed(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The stages train a classifier, cluster fingerprints and tokenise: none of this is SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
