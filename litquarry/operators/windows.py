"""Ordered-row operators: priority picks, newest rows, message windows, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def section_rank(section: Column | str = "section_path") -> Column:
    """Reading priority of a section: results first, unknown sections last."""
    s = F.lower(F.coalesce(F.col(section) if isinstance(section, str) else section, F.lit("")))
    ranked = ["result", "discussion", "conclusion", "abstract", "intro"]
    out = None
    for i, word in enumerate(ranked, 1):
        out = F.when(F.contains(s, F.lit(word)), i) if out is None else out.when(F.contains(s, F.lit(word)), i)
    return out.otherwise(len(ranked) + 1)


def priority_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """First ``n`` chunks per document by section priority, then id."""
    w = W.partitionBy("document_id").orderBy(section_rank(), F.col("chunk_id"))
    return chunks.withColumn("chunk_rank", F.row_number().over(w)).where(F.col("chunk_rank") <= n)


def next_sequence(existing: DataFrame, new: DataFrame, key: str, seq: str, order: list[str]) -> DataFrame:
    """Number appended rows after the highest number their key already has.

    New rows per key are one append call, a bounded batch.
    """
    top = existing.groupBy(key).agg(F.max(seq).alias("_top"))
    w = W.partitionBy(key).orderBy(*order)
    return new.join(top, key, "left").withColumn(
        seq, F.coalesce(F.col("_top"), F.lit(0)) + F.row_number().over(w)).drop("_top")


def last_messages(messages: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The last ``n`` messages per conversation, numbered in reading order."""
    back = W.partitionBy(key).orderBy(F.col(seq).desc())
    ahead = W.partitionBy(key).orderBy(seq)
    kept = messages.withColumn("_b", F.row_number().over(back)).where(F.col("_b") <= n).drop("_b")
    return kept.withColumn("position", F.row_number().over(ahead))


def stratified_sample(rows: DataFrame, label: str, targets: dict[str, int], order: Column, key: str) -> DataFrame:
    """Seeded sample with a target per label."""
    target = F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col(label))
    w = W.partitionBy(label).orderBy(order, key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(targets.values())).where(
        F.col("_n") <= target).drop("_n")


def clip_to_budget(hits: DataFrame, key: str, order: str, text: str, row_chars: int, total_chars: int) -> DataFrame:
    """Rows in order while the characters before them stay under the budget; each row clipped.

    Blank rows are skipped, so at most ``total_chars`` rows can ever be taken and the running sum
    only sees that many per key.
    """
    w = W.partitionBy(key).orderBy(order)
    top = hits.where(F.trim(text) != "").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= total_chars)
    cut_text = top.withColumn(text, F.substring(text, 1, row_chars))
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut_text.withColumn("chars_before", before).where(F.col("chars_before") < total_chars).drop("_n")
