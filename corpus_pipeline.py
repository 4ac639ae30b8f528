"""The corpus pipeline: documents pass quality, language, duplicates, mixing and packing, one table after the other."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from litquarry.llm import language_id, mixing, near_duplicates, packing, quality, queries  # noqa: E402
from litquarry.llm.common import register  # noqa: E402
from litquarry.scale import ensure_checkpoint_dir  # noqa: E402
from litquarry.sources.tables import table  # noqa: E402

LEAST_LANGUAGE_SCORE = 0.5
ORACLE_SQL = None  # models, fingerprints and tokens: tested against brute force in tests/llm


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold of operator 1, fitted on those of them that are labelled."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(docs, machine) >= quality.THRESHOLD)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that operator 8 learned from the table, with at least an even chance."""
    model = language_id.fit(docs)
    found = F.array(language_id.language_column(spark, model, F.col("text")))
    return docs.where(F.exists(found, lambda x: (x["lang_pred"] != language_id.UNKNOWN) & (x["score"] >= LEAST_LANGUAGE_SCORE)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, by the fingerprints and index of operator 4."""
    return near_duplicates.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as operator 5 takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, by operator 2."""
    return packing.pack(packing.cut_into_pieces(docs, queries.vocabulary("word_bpe_49k.json")))


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each_group), ("mixing", mixed), ("packing", packed)]


@register("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's input."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
