"""Route hits, reciprocal rank fusion, scope filters and rerank application.

Hits carry ``experiment_id, route, query_no, query, rank, document_id, chunk_id, score``.
Within one (experiment, route) there are at most queries x k hits, both configured, so
windows over that key stay small whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from litquarry.functions.core import first_non_blank, is_blank, nz, round_half_up
from litquarry.scale import small_side

RRF_K = 60
HIT = ["experiment_id", "route", "query_no", "query", "rank", "document_id", "chunk_id", "score"]


def hit_key() -> Column:
    return F.when(is_blank("chunk_id"), F.concat(F.lit("doc:"), F.col("document_id").cast("string"))).otherwise(
        F.concat(F.lit("chunk:"), F.col("chunk_id")))


def route_hits(per_query: DataFrame, route: str) -> DataFrame:
    """Number hits of one route across its queries, keeping the first of each key.

    ``per_query`` has ``experiment_id, query_no, query, rank, document_id, chunk_id, score``
    where rank restarts per query; the result's rank runs over the whole route.
    """
    first = W.partitionBy("experiment_id", "_key").orderBy("query_no", "rank")
    again = W.partitionBy("experiment_id").orderBy("query_no", "rank", "_key")
    return (
        per_query.withColumn("_key", hit_key())
        .withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
        .withColumn("rank", F.row_number().over(again))
        .withColumn("route", F.lit(route)).select(*HIT)
    )


def first_hit_per_document(hits: DataFrame) -> DataFrame:
    w = W.partitionBy("experiment_id", "route", "document_id").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def renumber(hits: DataFrame) -> DataFrame:
    w = W.partitionBy("experiment_id", "route").orderBy(F.col("rank").asc(), hit_key())
    return hits.withColumn("rank", F.row_number().over(w))


def scope_to(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep hits on allowed documents (``allowed(document_id)``) and renumber each route."""
    return renumber(hits.join(allowed.select("document_id").distinct(), "document_id", "left_semi").select(*HIT))


def marker_filter(hits: DataFrame, routes: list[str], marker: str) -> DataFrame:
    """Keep two routes' hits whose query mentions the marker, then renumber."""
    kept = hits.where(F.col("route").isin(routes))
    if marker and marker.strip():
        kept = kept.where(F.contains(F.lower(F.coalesce("query", F.lit(""))), F.lit(marker.strip().lower())))
    return renumber(kept)


def rrf(hits: DataFrame, routes: list[str], out_route: str, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion at chunk level, document level where a hit has no chunk."""
    fused = (
        hits.where(F.col("route").isin(routes)).withColumn("_key", hit_key())
        .groupBy("experiment_id", "_key")
        .agg(
            round_half_up(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"),
            F.min("document_id").alias("document_id"),
            F.min("chunk_id").alias("chunk_id"),
            F.min("query_no").alias("query_no"),
            # at most one entry per configured query
            F.array_join(F.array_sort(F.collect_set("query")), " | ").alias("query"),
        )
    )
    w = W.partitionBy("experiment_id").orderBy(F.col("score").desc(), F.col("_key").asc())
    ranked = fused.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.withColumn("route", F.lit(out_route)).select(*HIT)


def document_fusion(hits: DataFrame, k: int, max_documents: int) -> DataFrame:
    """Document-level fusion over queries and routes; keeps matched query and chunk counts.

    Ranks restart per (query, route) after repeated chunks are dropped, so a document
    scores once for each of its chunks.
    """
    first = W.partitionBy("experiment_id", "query_no", "route", "_key").orderBy("rank")
    again = W.partitionBy("experiment_id", "query_no", "route").orderBy("rank", "_key")
    ranked = (
        hits.withColumn("_key", hit_key()).withColumn("_n", F.row_number().over(first)).where("_n = 1")
        .withColumn("_r", F.row_number().over(again)).where(F.col("document_id").isNotNull())
    )
    docs = ranked.groupBy("experiment_id", "document_id").agg(
        round_half_up(F.sum(1.0 / (F.lit(max(1, k)) + F.col("_r"))), 9).alias("score"),
        F.countDistinct("query_no").alias("matched_queries"),
        F.countDistinct(nz("chunk_id")).alias("matched_chunks"),
    )
    w = W.partitionBy("experiment_id").orderBy(F.col("score").desc(), F.col("document_id").cast("string"))
    return docs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_documents)


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, limit: int) -> DataFrame:
    """Dense plus lexical hits, fused; an experiment without lexical hits keeps its dense order."""
    # both inputs hold one route; without lexical hits the fused order equals the dense order
    both = dense.withColumn("route", F.lit("dense")).unionByName(lexical.withColumn("route", F.lit("lexical")))
    return rrf(both, ["dense", "lexical"], "hybrid", k, limit)


def graph_fusion(text_hits: DataFrame, graph_hits: DataFrame, k: int, limit: int) -> DataFrame:
    """Fuse text hits with graph hits; key is the chunk, else the graph entity, else the text.

    Both inputs: ``experiment_id, rank, chunk_id, graph_entity, text``.
    """
    key = first_non_blank("chunk_id", "graph_entity", "text")
    both = text_hits.withColumn("_src", F.lit(0)).unionByName(graph_hits.withColumn("_src", F.lit(1)))
    keyed = both.withColumn("hit_key", key)
    once = keyed.groupBy("experiment_id", "_src", "hit_key").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("experiment_id", "hit_key").agg(
        round_half_up(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    w = W.partitionBy("experiment_id").orderBy(F.col("score").desc(), F.col("hit_key"))
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rerank_candidates(hits: DataFrame, chunks: DataFrame, route: str, chunks_per_document: int = 5,
                      max_documents: int | None = None, max_chars: int = 7800) -> DataFrame:
    """Documents of one route with the text a scorer should read.

    Chunks that were hit come first (in hit order), then the document's other chunks in
    order; ``chunks(document_id, chunk_id, chunk_index, title, section_path, text)``.
    """
    cand = hits.where((F.col("route") == route) & F.col("document_id").isNotNull())
    docs = renumber(first_hit_per_document(cand))
    if max_documents:
        docs = docs.where(F.col("rank") <= max_documents)
    docs = docs.select("experiment_id", "document_id", F.col("rank").alias("doc_rank"), "query")
    preferred = cand.where(~is_blank("chunk_id")).groupBy("experiment_id", "document_id", "chunk_id").agg(
        F.min("rank").alias("_pref"))
    w = W.partitionBy("experiment_id", "document_id").orderBy(
        F.col("_pref").asc_nulls_last(), F.col("chunk_index"), F.col("chunk_id"))
    chosen = (
        docs.join(chunks, "document_id")
        .join(preferred, ["experiment_id", "document_id", "chunk_id"], "left")
        .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= chunks_per_document)
    )
    body = F.concat(
        F.lit("\nEvidence "), F.col("_n").cast("string"), F.lit("\nSection: "),
        F.coalesce(nz("section_path"), F.lit("-")), F.lit("\n"), F.coalesce(nz("text"), F.lit("")))
    parts = chosen.groupBy("experiment_id", "document_id").agg(
        F.min_by(F.coalesce(nz("title"), F.lit("")), "_n").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", body.alias("body")))),
                                 lambda x: x["body"]), "").alias("body"),
    )
    full = F.concat(
        F.lit("Document ID: "), F.col("document_id").cast("string"), F.lit("\n"),
        F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Title: "), F.col("title"), F.lit("\n"))).otherwise(""),
        F.lit("Candidate query evidence: "), F.coalesce("query", F.lit("")), F.lit("\n"),
        F.coalesce("body", F.lit("")))
    clipped = F.when(F.length("doc_text") <= max_chars, F.col("doc_text")).otherwise(
        F.concat(F.substring("doc_text", 1, max_chars), F.lit("\n[truncated]")))
    return (docs.join(parts, ["experiment_id", "document_id"], "left")
            .withColumn("doc_text", full).withColumn("doc_text", clipped)
            .select("experiment_id", "document_id", "doc_rank", "query", "doc_text"))


def apply_rerank(candidates: DataFrame, scores: DataFrame, min_score: float = 0.5,
                 fallback: bool = False) -> DataFrame:
    """Keep candidates whose score passes, best first, ties by earlier rank.

    ``scores(experiment_id, document_id, rerank_score)``; an unscored document counts as 0.
    With ``fallback`` an experiment that loses every candidate keeps its old order.
    """
    joined = candidates.join(scores, ["experiment_id", "document_id"], "left").withColumn(
        "rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    kept = joined.where(F.col("rerank_score") >= min_score)
    if fallback:
        empty = joined.join(kept.select("experiment_id").distinct(), "experiment_id", "left_anti")
        kept = kept.unionByName(empty.withColumn("rerank_score", F.lit(0.0)))
    w = W.partitionBy("experiment_id").orderBy(F.col("rerank_score").desc(), F.col("doc_rank"))
    return kept.withColumn("rank", F.row_number().over(w))


def expand_with_chunks(doc_hits: DataFrame, priority: DataFrame) -> DataFrame:
    """Replace each document hit by its priority chunks; keep a document-only hit when it has none.

    ``priority(document_id, chunk_id, chunk_rank)``.
    """
    w = W.partitionBy("experiment_id", "query_no").orderBy("doc_rank", F.col("chunk_rank").asc_nulls_first())
    return (
        doc_hits.withColumnRenamed("rank", "doc_rank").join(priority, "document_id", "left")
        .withColumn("rank", F.row_number().over(w)).drop("doc_rank", "chunk_rank")
    )


def effective_judgments(judgments: DataFrame) -> DataFrame:
    """Label after human override."""
    return judgments.withColumn("effective_label", F.coalesce(nz("override_label"), F.col("label")))


def reuse_judgments(target: DataFrame, source: DataFrame, experiment_id) -> DataFrame:
    """Copy a source experiment's judgments; documents already judged in the target keep theirs."""
    copied = source.withColumn("experiment_id", F.lit(experiment_id)).select(*target.columns)
    return target.unionByName(copied.join(target.select("experiment_id", "document_id"), ["experiment_id", "document_id"], "left_anti"))
