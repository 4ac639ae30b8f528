"""Operators built directly from the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from litquarry.functions import pages as pg


def page_layer_report(pages: DataFrame) -> DataFrame:
    """Text-layer status per document from its pages' character counts."""
    layer = pages.select("document_id", pg.text_layer("text").alias("layer"))
    agg = layer.groupBy("document_id").agg(
        F.sum("layer.visible").alias("visible_chars"), F.sum("layer.replaced").alias("_r"),
        F.avg(pg.page_is_usable(F.col("layer")).cast("double")).alias("usable_ratio"))
    rr = F.when(F.col("visible_chars") == 0, 0.0).otherwise(F.col("_r") / F.col("visible_chars"))
    return agg.withColumn("replacement_ratio", rr).withColumn(
        "status", pg.text_layer_status(F.col("visible_chars"), F.col("usable_ratio"), F.col("replacement_ratio"))).drop("_r")


def table_candidates(pages: DataFrame) -> DataFrame:
    """Lines that caption a table or hold an activity matrix; one row per page, source and folded line.

    ``pages(document_id, page_number, activity_page, text)``.
    """
    lines = pages.select("document_id", "page_number", "activity_page", F.explode(F.split("text", r"\r?\n")).alias("line"))
    line = F.col("line")
    both = F.filter(F.array(F.when(pg.has(line, pg.CAPTION), F.lit("TEXT_CAPTION")), F.when(pg.has(line, pg.MATRIX), F.lit("TEXT_MATRIX"))),
                    lambda s: s.isNotNull())
    found = lines.select("*", F.explode(both).alias("source")).withColumn("kind", pg.table_kind(line, F.col("activity_page")))
    key = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    return found.withColumn("line_key", key).groupBy("document_id", "page_number", "source", "line_key").agg(
        F.min("kind").alias("kind"))
