"""Hybrid retrieval for a question, the context's budget, and prompts for three chat templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEMANTIC, LEXICAL, FINAL, BUDGET, LEXICAL_FACTOR, HISTORY = 10, 5, 5, 3000, 0.8, 4

# Fixed value: the system message.
SYSTEM = (
    "You are a helpful research assistant answering questions about the user's personal knowledge archive. Rules:\n"
    "- Base your answer ONLY on the provided sources\n"
    "- Cite sources inline using [1], [2], etc.\n"
    "- If the sources don't contain enough information, say so honestly\n"
    "- Be concise but thorough"
)
#: Fixed values: (before the system message, after it, before a turn's role, after it, after its text, the last opener).
TEMPLATES = {
    "chatml": ("<|im_start|>system\n", "<|im_end|>\n", "<|im_start|>", "\n", "<|im_end|>\n", "<|im_start|>assistant\n"),
    "llama3": (
        "<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>",
        "<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n",
    ),
    "gemma": ("<start_of_turn>user\n", "\n\n", "<end_of_turn>\n<start_of_turn>", "\n", "", "<end_of_turn>\n<start_of_turn>model\n"),
}


def hybrid(semantic: DataFrame, lexical: DataFrame, chunk_scores: DataFrame, k: int = FINAL) -> DataFrame:
    """``query_id, entry_id, chunk_index, score, rank`` for each question.

    ``semantic(query_id, entry_id, chunk_index, score)``: chunks by similarity, of which the best ten count.
    ``lexical(query_id, entry_id, score)``: hits of the full-text search, of which the best five count. Those whose
    entry is not among the first ones bring their entry's best chunk from ``chunk_scores`` (same columns as
    ``semantic``), at 0.8 of its score. The best chunk of each entry stays.
    """
    keys = ["query_id", "entry_id"]
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id", "chunk_index")
    first = semantic.withColumn("n", F.row_number().over(per_query)).where(F.col("n") <= SEMANTIC).drop("n")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    hits = lexical.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= LEXICAL)
    extra = hits.select(*keys).distinct().join(first.select(*keys), keys, "left_anti")
    best = best_chunk(chunk_scores.join(extra, keys, "left_semi"))
    both = first.unionByName(best.withColumn("score", F.col("score") * LEXICAL_FACTOR))
    ranked = best_chunk(both).withColumn("rank", F.row_number().over(per_query))
    return ranked.where(F.col("rank") <= k)


def best_chunk(scores: DataFrame) -> DataFrame:
    """The highest score of each (query, entry); of equals the first chunk. One aggregation, no window."""
    best = F.max(F.struct("score", (-F.col("chunk_index")).alias("place"))).alias("b")
    found = scores.groupBy("query_id", "entry_id").agg(best)
    return found.select("query_id", "entry_id", (-F.col("b.place")).cast("int").alias("chunk_index"), F.col("b.score").alias("score"))


def within_budget(rows: DataFrame, budget: int = BUDGET, text_col: str = "chunk_text", key: str = "query_id") -> DataFrame:
    """Rows in order of ``rank`` while those before hold less than ``budget`` bytes, with ``label`` [1], [2] …

    ``rank`` is unique for a key. Only lengths are sorted; texts join the few rows that stay.
    """
    order = Window.partitionBy(key).orderBy("rank")
    used = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.select(key, "rank", F.octet_length(text_col).alias("size"))
    # Rows stay from the first on, so a row's number is its place among those that stay.
    kept = sizes.select(key, "rank", used.cast("long").alias("used_before"), F.row_number().over(order).alias("n")).where(F.col("used_before") < budget)
    kept = kept.withColumn("label", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]"))).drop("n")
    return rows.join(kept, [key, "rank"])


def history_tail(turns: DataFrame, count: int = HISTORY, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``count`` messages of each conversation, whoever said them."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_n", place).where(F.col("_n") <= count).drop("_n")


def prompt(sources: Column, history: Column, question: Column, template: str = "chatml") -> Column:
    """``sources``: array of struct(label, title, text) in order; ``history``: array of struct(role, text) in order."""
    opening, closing, before, between, after, last = TEMPLATES[template]
    listed = F.array_join(F.transform(sources, lambda s: F.concat(s["label"], F.lit(' "'), s["title"], F.lit('"\n'), s["text"], F.lit("\n\n"))), "")
    asked = F.concat(F.lit("Sources:\n"), listed, F.lit("Question: "), question)
    role = (lambda r: F.when(r == "user", r).otherwise("model")) if template == "gemma" else (lambda r: r)
    said = F.array_join(F.transform(history, lambda m: F.concat(F.lit(before), role(m["role"]), F.lit(between), m["text"], F.lit(after))), "")
    turn = F.lit("") if template == "gemma" else F.lit(f"{before}user{between}")
    return F.concat(F.lit(opening + SYSTEM + closing), said, turn, asked, F.lit(after + last))
