"""Folder ingest, index maintenance and file digests, replayed from the tables through files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from litquarry.plans.corpus_queries import DEDUP_IN, greedy_sql
from litquarry.plans.registry import query
from litquarry.plans.views import sql, tok
from litquarry.scale import ensure_checkpoint_dir
from litquarry.sources import scans as sc
from litquarry.sources.tables import table
from litquarry.streaming import ingest as si

c = F.col
DROPS = 5  # more than a tier of segments holds


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _drops(rows: DataFrame, folder: str, turn: Column, run: Callable[[str, str, str], StreamingQuery]) -> None:
    """Write the rows of every turn in its own folder and let a stream that starts anew each time read what is new."""
    for i in range(DROPS):
        rows.where(turn == i).write.parquet(f"{folder}/in/drop={i}")
        run(f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()


@query("x1_folder_ingest", sql("""SELECT doc_id AS document_id, CASE WHEN trim(text) = '' THEN 'FAILED' WHEN doc_id IN (SELECT document_id FROM canon) THEN 'COMPLETED' ELSE 'DUPLICATE_SKIPPED' END AS status,
    CASE WHEN trim(text) <> '' AND doc_id NOT IN (SELECT document_id FROM canon) THEN coalesce(a, b) END AS duplicate_of FROM documents LEFT JOIN
    (SELECT dn.*, (SELECT max(document_id) FROM canon x WHERE x.doi = dn.doi AND x.document_id < dn.document_id) AS a,
      (SELECT max(document_id) FROM canon x WHERE x.sha = dn.sha AND x.document_id < dn.document_id) AS b FROM dn) p ON p.document_id = doc_id""",
    extra=DEDUP_IN + ",\n dn AS (SELECT * FROM dd WHERE document_id IN (SELECT doc_id FROM documents WHERE trim(text) <> '')),\n" + greedy_sql("dn", ["doi", "sha"], 6)))
def x1(spark, d):
    """Documents arrive in stretches of their ids; every stretch is another start of the stream."""
    t = table(spark, d, "documents", "doc_id", "text").select(
        c("doc_id").alias("document_id"), F.when(c("doc_id") % 3 == 0, F.concat(F.lit("10.1000/"), F.floor(c("doc_id") / 9).cast("string"))).alias("doi"), "text")
    most = t.agg(F.max("document_id")).first()[0] or 0
    folder = _folder(spark, "folder-ingest")
    _drops(t, folder, F.floor(c("document_id") * DROPS / (most + 1)), lambda i, o, s: si.ingest_folder(spark, i, o, s, fmt="parquet"))
    return spark.read.schema(si.OUTCOME).parquet(f"{folder}/out/outcomes").select("document_id", "status", "duplicate_of")


@query("x1_ingest_counters", sql("""SELECT CASE WHEN trim(text) = '' THEN 'FAILED' WHEN doc_id IN (SELECT document_id FROM canon) THEN 'COMPLETED' ELSE 'DUPLICATE_SKIPPED' END AS status, count(*) AS n FROM documents GROUP BY 1""",
    extra=DEDUP_IN + ",\n dn AS (SELECT * FROM dd WHERE document_id IN (SELECT doc_id FROM documents WHERE trim(text) <> '')),\n" + greedy_sql("dn", ["doi", "sha"], 6)))
def x1_counters(spark, d):
    return x1(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("x2_index_segments", f"""WITH live AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN split_part(text, chr(10), 1) ELSE text END AS t FROM documents WHERE doc_id % 5 <> 0),
    l AS MATERIALIZED (SELECT doc_id, {tok('t')} AS l FROM live), u AS MATERIALIZED (SELECT doc_id, unnest(l) AS term FROM l)
    SELECT doc_id, 'text' AS field, len(l) AS dl, term, tf FROM (SELECT doc_id, term, count(*) AS tf FROM u GROUP BY doc_id, term) JOIN l USING (doc_id)""")
def x2(spark, d):
    """Documents arrive in three turns; then every seventh comes again as its first line, then every fifth is deleted."""
    t = table(spark, d, "documents", "doc_id", "text").select(c("doc_id").alias("document_id"), "text", F.lit(False).alias("deleted"), F.lit(None).cast("long").alias("sequence"))
    first = t.withColumn("turn", c("document_id") % 3)
    again = t.where("document_id % 7 = 0").withColumn("text", F.substring_index("text", "\n", 1)).withColumn("turn", F.lit(3))
    gone = t.where("document_id % 5 = 0").withColumn("text", F.lit(None).cast("string")).withColumn("deleted", F.lit(True)).withColumn("turn", F.lit(4))
    folder = _folder(spark, "index-segments")
    _drops(first.unionByName(again).unionByName(gone), folder, c("turn"), lambda i, o, s: si.index_stream(spark, i, o, s, fmt="parquet"))
    return si.current_index(spark, f"{folder}/out").postings


@query("s3_file_digests", "SELECT page_id, octet_length(encode(html)) + 1 AS length, sha256(html || chr(10)) AS sha256 FROM pages")
def s3(spark, d):
    """Every page as a file of its own below a folder tree, found again by walking it."""
    folder = _folder(spark, "pages")
    sc.write_files(table(spark, d, "pages", "page_id", "html"), folder, "page_id", "html")
    return sc.scan_files(spark, folder, "part-*").select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), "length", "sha256")
