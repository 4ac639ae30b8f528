"""Filters, joins and counters over evidence and run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from litquarry.functions.core import nz, ratio
from litquarry.scale import small_side

MAX_INT = 2_147_483_647


def batch_report(outcomes: DataFrame, sums: list[str]) -> DataFrame:
    """Outcome counts, summed measures and overall status per batch; ``outcomes(batch_id, status, ...)``."""
    s = F.col("status")
    r = outcomes.groupBy("batch_id").agg(
        F.count("*").alias("processed"), F.count_if(s == "COMPLETED").alias("completed"),
        F.count_if(s == "DUPLICATE_SKIPPED").alias("duplicates"),
        F.count_if(~s.isin("COMPLETED", "DUPLICATE_SKIPPED")).alias("failed"), *[F.sum(c).alias(c) for c in sums])
    return r.withColumn("status", F.when(F.col("failed") == 0, "COMPLETED").when(
        F.col("completed") + F.col("duplicates") == 0, "FAILED").otherwise("PARTIAL_FAILED"))


def canonical_completed(docs: DataFrame) -> DataFrame:
    """Finished documents that are nobody's duplicate."""
    return docs.where((F.col("status") == "COMPLETED") & F.col("duplicate_of").isNull())


def collect_garbage(vectors: DataFrame, key: str, rejected: DataFrame, rejected_key: str) -> tuple[DataFrame, DataFrame]:
    """Vectors without those of rejected documents, and the dry-run count of what goes."""
    gone = rejected.select(F.col(rejected_key).alias(key)).distinct()
    report = gone.join(vectors.select(key, F.lit(1).alias("_v")), key, "left").agg(
        F.countDistinct(key).alias("documents"), F.count("_v").alias("vectors"))
    return vectors.join(gone, key, "left_anti"), report


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Conjunction of the conditions that were given; ``None`` means no restriction."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def with_child(df: DataFrame, child: DataFrame, keys: list[str], *conditions: Column | None) -> DataFrame:
    """Rows that have a child row meeting the optional conditions."""
    return df.join(where_all(child, *conditions).select(*keys).distinct(), keys, "left_semi")


def page(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """One page of an ordered result with the total row count on every row."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(max(0, page_no) * size).limit(size)
    return rows.join(F.broadcast(total), F.lit(True))  # one row


def page_after(df: DataFrame, key: str, last_key, size: int) -> DataFrame:
    """Next page by key rather than by offset, for deep scans."""
    return df.where(F.col(key) > F.lit(last_key)).orderBy(key).limit(size)


def digits_or_max(value: Column) -> Column:
    """Integer of an all-digit text, else the largest integer, so that such rows sort last."""
    return F.when(F.rlike(value, F.lit("^[0-9]+$")), value.try_cast("int")).otherwise(F.lit(MAX_INT))


def search_names(entities: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring search over name, key and aliases (an array)."""
    n = needle.strip().lower()
    inside = lambda c: F.contains(F.lower(c), F.lit(n))
    return entities.where(inside(F.col("canonical_name")) | inside(F.col("normalized_key")) | F.exists("aliases", inside))


def retained_inputs(matches: DataFrame, include: tuple[str, ...] = ("SUPPORTED", "UNCERTAIN")) -> DataFrame:
    return matches.where(F.col("status").isin(*include))


def latest_per(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the highest ``order`` per key, by partial aggregation rather than a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def best_match(left: DataFrame, right: DataFrame, key_pairs: list[tuple[str, str]], left_key: str, order: list[str],
               columns: list[str]) -> DataFrame:
    """Best right row reachable by any of several equality keys; one equi join per alternative."""
    parts = []
    for l, r in key_pairs:
        rr = right.select(F.col(r).alias("_k"), *order, *[c for c in columns if c not in order])
        parts.append(left.select(left_key, F.col(l).alias("_k")).join(rr, "_k").drop("_k"))
    return latest_per(reduce(DataFrame.unionByName, parts), [left_key], order, columns)


def by_id_else_hash(requests: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve requests by id, else by content hash; returns resolved rows and the unresolved.

    ``requests(request_id, document_id, sha)``, ``docs(document_id, sha)``.
    """
    ids = docs.select(F.col("document_id").alias("_by_id"))
    hashes = docs.groupBy("sha").agg(F.min("document_id").alias("_by_hash"))
    j = requests.join(ids, F.col("document_id") == F.col("_by_id"), "left").join(hashes, "sha", "left")
    out = j.select("request_id", F.coalesce("_by_id", "_by_hash").alias("resolved_id"),
                   F.when(F.col("_by_id").isNotNull(), "ID").when(F.col("_by_hash").isNotNull(), "HASH").alias("resolved_by"))
    return out.where("resolved_id IS NOT NULL"), out.where("resolved_id IS NULL").select("request_id")


def neighbours(pages: DataFrame, centres: DataFrame, radius: int, key: str = "document_id", page_col: str = "page_number") -> DataFrame:
    """Pages within ``radius`` of a centre page that exist; equi join after expanding the few offsets."""
    spread = centres.select(key, F.explode(F.sequence(F.col(page_col) - radius, F.col(page_col) + radius)).alias(page_col)).distinct()
    return pages.join(spread, [key, page_col], "left_semi")


def confusion(gold: DataFrame, predicted: DataFrame, keys: list[str], slice_by: list[str]) -> DataFrame:
    """TP, FP, FN of two yes/no tables (``positive``) after a full outer join, with precision, recall and F1."""
    g = gold.select(*keys, F.col("positive").alias("_g"))
    p = predicted.select(*keys, F.col("positive").alias("_p"))
    j = g.join(p, keys, "full").na.fill(False, ["_g", "_p"])
    return prf(j.groupBy(*slice_by).agg(
        F.count_if(F.col("_g") & F.col("_p")).alias("tp"), F.count_if(~F.col("_g") & F.col("_p")).alias("fp"),
        F.count_if(F.col("_g") & ~F.col("_p")).alias("fn")))


def prf(counts: DataFrame) -> DataFrame:
    c = F.col
    p, r = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    return (counts.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"))))


def micro_average(counts: DataFrame, slice_col: str) -> DataFrame:
    """Slices plus the total over all of them, from one rollup."""
    s = counts.rollup(slice_col).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")], F.grouping(slice_col).alias("_all"))
    named = s.withColumn(slice_col, F.when(F.col("_all") == 1, "@all").otherwise(F.col(slice_col).cast("string"))).drop("_all")
    return prf(named)
