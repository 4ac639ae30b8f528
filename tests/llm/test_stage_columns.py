"""Stages of the pipeline keep all columns, whatever their names and types."""

import corpus_pipeline
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_clashing_names_and_maps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plain = docs.columns
    odd = docs.select("*", F.lit("x").alias("a.b"), F.lit(1).alias("_quality"), F.lit(2).alias("_language"), F.lit(3).alias("_kept"), F.lit(4).alias("_one"),
                      F.create_map(F.lit("k"), F.col("source")).alias("tags"), F.array(F.create_map(F.lit(1), F.col("doc_id"))).alias("deep"))
    odd = odd.unionByName(odd.limit(5))  # rows equal in all columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, FOLDER)
        same = stage(spark, odd.select(*plain), FOLDER)
        assert got.columns == odd.columns, name
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in same.select("doc_id").collect()), name
        assert got.where("`a.b` = 'x' AND _quality = 1 AND _language = 2 AND _kept = 3 AND _one = 4 AND element_at(tags, 'k') <=> source").count() == same.count(), name
