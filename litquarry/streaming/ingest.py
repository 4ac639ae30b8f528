"""Incremental document ingest, index maintenance and telemetry with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from litquarry.functions.core import nz
from litquarry.operators import retrieval as rt
from litquarry.scale import cut, join_known, small_side
from litquarry.streaming.segments import Segments

DOCUMENTS = "document_id long, doi string, text string"


def _write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    # a folder per batch, replaced as a whole, so that a replayed batch leaves the same files
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


KEYS = "key string, document_id long"
OUTCOME = "document_id long, status string, duplicate_of long"


def accepted_keys(spark: SparkSession, target: str) -> Segments:
    """Keys of accepted documents and who holds them, each stored sorted so that a lookup skips what it cannot hold."""
    return Segments(spark, f"{target}/keys", KEYS, lambda rows: rows.repartitionByRange("key").sortWithinPartitions("key"))


def ingest_folder(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = DOCUMENTS, fmt: str = "json") -> StreamingQuery:
    """Read new files, accept documents whose DOI and content are new, record an outcome per document.

    The state is the table of accepted keys in few merged segments; a batch looks its own keys up there and no more, so
    neither memory nor the number of files read grows with the batches. A missing DOI is no key.
    Inside a batch the arrival order is the document id, then the place read, and only accepted rows register their
    keys. So of rows that repeat an id and a text one is accepted and each other counts as its duplicate. A restart goes on
    from the checkpoint, and a replayed batch replaces its own files.
    """
    from litquarry.operators.corpus import greedy_canonical

    def run(batch: DataFrame, batch_id: int) -> None:
        # the places are pinned, as every later step must see the same ones
        rows = cut(batch.select(F.struct("document_id", F.monotonically_increasing_id().alias("place")).alias("_o"), F.concat(F.lit("doi:"), nz("doi")).alias("doi"),
                                F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"), nz("text").isNull().alias("failed")))
        asked = rows.where("NOT failed").select(F.explode(F.array_compact(F.array("doi", "sha"))).alias("key")).distinct()
        state = accepted_keys(spark, target)
        old = cut(state.read(batch_id).join(small_side(asked), "key", "left_semi"))
        held = lambda df, key, name: join_known(df, old.select(F.col("key").alias(key), F.col("document_id").alias(name)), key, "left")
        j = cut(held(held(rows, "doi", "_a"), "sha", "_b"))
        fresh = j.where("NOT failed AND _a IS NULL AND _b IS NULL").select("_o", "doi", "sha")
        canon = cut(greedy_canonical(fresh, "_o", ["doi", "sha"]))
        out = join_known(j, canon.where("doi IS NOT NULL").select("doi", F.col("_o").alias("_c")), "doi", "left")
        out = join_known(out, canon.select("sha", F.col("_o").alias("_d")), "sha", "left")
        earlier = lambda o: F.when(F.col(o) < F.col("_o"), F.col(f"{o}.document_id"))
        mine = (F.col("_c") == F.col("_o")) | (F.col("_d") == F.col("_o"))
        dup = F.when(~F.coalesce(mine, F.lit(False)), F.coalesce("_a", earlier("_c"), "_b", earlier("_d")))
        outcome = out.select("_o.document_id", F.when(F.col("failed"), "FAILED").when(dup.isNotNull(), "DUPLICATE_SKIPPED").otherwise("COMPLETED").alias("status"),
                             F.when(~F.col("failed"), dup).alias("duplicate_of"))
        _write_batch(outcome, f"{target}/outcomes", batch_id)
        state.append(canon.select(F.explode(F.array_compact(F.array("doi", "sha"))).alias("key"), F.col("_o.document_id").alias("document_id")), batch_id)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_counters(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(OUTCOME).parquet(f"{target}/outcomes").groupBy("status").agg(F.count("*").alias("n"))


POSTING = "doc_id long, field string, dl long, term string, tf long, version long"
TOUCHED = "doc_id long, version long"


def posting_segments(spark: SparkSession, target: str) -> tuple[Segments, Segments]:
    """Postings and tombstones: the last version of every touched document. Merging drops what the merged segments replace."""
    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.max("version").alias("version"))

    touched = Segments(spark, f"{target}/touched", TOUCHED, newest)

    def without_replaced(postings: DataFrame) -> DataFrame:
        return postings.join(newest(touched.read()), ["doc_id", "version"], "left_semi")

    return Segments(spark, f"{target}/postings", POSTING, without_replaced), touched


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "document_id long, text string, deleted boolean, sequence long", fmt: str = "json") -> StreamingQuery:
    """Add the postings of changed documents and a tombstone per touched document as segments, merged tier by tier.

    A document's postings are those of its last row: the largest ``sequence`` of the last batch that has it, without
    one the latest file and the last place in it. A deletion leaves only its tombstone. A batch writes its own
    segments and merges full tiers; a replayed batch replaces its own files.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_place", F.monotonically_increasing_id())
        order = F.struct(F.coalesce("sequence", F.lit(-1)), "_time", "_path", "_start", "_place")
        last = cut(rows.groupBy("document_id").agg(F.max_by(F.struct("text", "deleted"), order).alias("r")).select("document_id", "r.*"))
        live = last.where(~F.coalesce("deleted", F.lit(False)))
        index = rt.build_index(live, "document_id", {"text": F.col("text")})
        version = F.lit(batch_id).cast("long").alias("version")
        postings, touched = posting_segments(spark, target)
        touched.append(last.select(F.col("document_id").alias("doc_id"), version), batch_id)
        postings.append(index.postings.select("doc_id", "field", "dl", "term", "tf", version), batch_id)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    if "sequence" not in stream.columns:
        stream = stream.withColumn("sequence", F.lit(None).cast("long"))
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, target: str) -> rt.InvertedIndex:
    """Postings of each document's last version: the segments less what their tombstones replace."""
    postings, touched = posting_segments(spark, target)
    last = touched.read().groupBy("doc_id").agg(F.max("version").alias("version"))
    return rt.InvertedIndex(postings.read().join(last, ["doc_id", "version"], "left_semi").drop("version"))


def usage_stream(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Calls, tokens and elapsed time per window, phase and model: streaming form of the usage report.

    ``events(ts, phase, model, tokens, elapsed_ms)``; also runs on a batch frame.
    """
    e = events
    if events.isStreaming:  # a watermark needs a zoned timestamp
        e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return e.groupBy(F.window("ts", window).alias("w"), "phase", "model").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("elapsed_ms").alias("elapsed_ms")).select(
        F.col("w.start").alias("window_start"), "phase", "model", "calls", "tokens", "elapsed_ms")
