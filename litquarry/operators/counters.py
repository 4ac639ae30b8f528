"""Status counters, telemetry and result matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def status_counters(rows: DataFrame, status: str, values: list[str]) -> DataFrame:
    """Total and one counter per status value, in one pass."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v.lower()) for v in values])


def refresh_counters(batches: DataFrame, children: DataFrame, key: str, counters: dict[str, Column]) -> DataFrame:
    """Counters of every batch from one aggregation of its children; a batch without children gets zeros."""
    agg = children.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in counters.items()])
    return batches.select(key).join(agg, key, "left").na.fill(0, list(counters))


def usage(events: DataFrame) -> DataFrame:
    """Calls, tokens and elapsed time per phase and model: ``events(phase, model, tokens, elapsed_ms)``."""
    return events.groupBy("phase", "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"),
                                                F.sum("elapsed_ms").alias("elapsed_ms"))


def result_matrix(documents: DataFrame, results: DataFrame, questions: list[str]) -> DataFrame:
    """One row per document with status, confidence and evidence count per question; blank when absent."""
    wide = results.groupBy("document_id").pivot("question_id", questions).agg(
        F.max("status").alias("status"), F.max("confidence").alias("confidence"), F.sum("evidence_rows").alias("rows"))
    return documents.select("document_id").join(wide, "document_id", "left")


def failures(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Failed documents and failed questions in one list."""
    doc = documents.where("status = 'FAILED'").select("document_id", F.lit(None).cast("string").alias("question_id"), F.lit("DOCUMENT").alias("level"))
    q = results.where("status = 'FAILED'").select("document_id", "question_id", F.lit("QUESTION").alias("level"))
    return doc.unionByName(q)
