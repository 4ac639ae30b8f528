"""Mixing sources to target weights with hash-threshold histograms: sums, nested thresholds, a filter, and no sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from litquarry.llm.common import WORD
from litquarry.scale import cut, global_rank, small_side

WEIGHTS = (3.0, 1.0, 2.0)  # repeating over the sources by code point, null last
SHARE = 1.5  # of all sizes
MOST_COPIES = 2
DIGITS, LEVELS = 3, 4  # hex digits settled at each level, levels


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """Where a document stands in the fixed order of its source: the first 12 hex digits of a digest of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.substring(digest, 1, DIGITS * LEVELS)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows, one per source.

    Weights repeat over the sources in code-point order, null last. What exceeds ``most`` times a source's size is
    given to the others by weight until none is above; each round is one sum over the sources' table.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    ranked = global_rank(totals, [], [F.col("_null"), F.col("source")], "_r").withColumn(
        "_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_r") - 1) % len(weights) + 1).cast("int")))
    ranked = cut(ranked.select("source", "source_size", "_w", (F.lit(float(most)) * F.col("source_size")).alias("_cap")))
    budget = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    bound, rest, weight = F.lit(False), budget, None
    while True:  # ends: every round binds another source or stops
        capped, free = ranked.agg(F.sum(F.when(bound, F.col("_cap")).otherwise(0.0)), F.sum(F.when(~bound, F.col("_w")).otherwise(0.0))).first()
        rest, weight = budget - (capped or 0.0), free or 0.0
        if not weight:
            return ranked.select("source", "source_size", F.col("_cap").alias("target"))
        now = bound | (F.lit(rest) * F.col("_w") / F.lit(weight) > F.col("_cap"))
        if not ranked.where(now & ~bound).limit(1).count():
            break
        ranked = cut(ranked.withColumn("_b", now))
        bound = F.col("_b")
    return ranked.select("source", "source_size", F.when(bound, F.col("_cap")).otherwise(F.lit(rest) * F.col("_w") / F.lit(weight)).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, whole, bound): every document is taken ``whole`` times, and once more if its place is below ``bound``.

    Level by level, sizes are summed by source and the next digits of the place; the bucket in which the sum passes
    the budget is the boundary, and only its documents are summed again. After the last level the boundary is one
    place; it is included if that comes nearer to the budget.
    """
    state = targets.select("source", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("int").alias("whole"),
                           "source_size", "target").withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
    state = cut(state.select("source", "whole", "rest", F.lit("").alias("prefix")))
    for level in range(1, LEVELS + 1):
        key = F.substring("place", 1, DIGITS * level)
        of = state.select(F.col("source").alias("_s"), "prefix", "rest").where("prefix is not null")
        edge = sizes.select("source", key.alias("_k"), "size").join(
            small_side(of), F.col("source").eqNullSafe(F.col("_s")) & F.col("_k").startswith(F.col("prefix")), "inner")
        # at most 16**DIGITS rows a source meet in the window
        sums = edge.groupBy("source", "_k", "rest").agg(F.sum("size").alias("_n"))
        order = Window.partitionBy("source").orderBy("_k")
        sums = sums.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
        over = sums.where(F.col("_before") + F.col("_n") > F.col("rest")).groupBy("source").agg(F.min(F.struct("_k", "_before", "_n")).alias("_e"))
        joined = state.join(small_side(over.withColumnRenamed("source", "_s2")), F.col("source").eqNullSafe(F.col("_s2")), "left")
        state = cut(joined.select(
            "source", "whole", (F.col("rest") - F.coalesce(F.col("_e._before"), F.lit(0))).alias("rest"),
            F.when(F.col("prefix").isNotNull(), F.col("_e._k")).alias("prefix"), F.col("_e._n").alias("edge")))
    # no boundary: all fits, so every place is below the bound
    include = F.col("edge") - F.col("rest") < F.col("rest")
    return state.select("source", "whole", F.when(F.col("prefix").isNull(), F.lit("g")).when(include, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix")).alias("bound"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``, and the columns in ``keep``.

    ``taken`` is a whole multiple of ``size``, 0 to ``most`` times; the sum over a source differs from its target by
    less than the boundary document. Rows equal in id and text share one place and are taken alike. A null text has
    size 0; a null source is a source; no row gives no row. The choice depends on ids, texts and sizes only, so
    reruns agree. A hot source is never gathered: its rows only meet sums of at most 16**DIGITS buckets.
    """
    own = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"))
    sizes = own if keep else cut(own)
    facts = cut(own.select("source", "size", "place")) if keep else sizes
    targets = cut(source_targets(facts, weights, share, most))
    bounds = cut(thresholds(facts, targets))
    plan = targets.join(bounds.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_source"), "source_size", "target", "whole", "bound")
    if keep:
        sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"),
                            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"))
    copies = F.col("whole") + F.when(F.col("whole") >= most, 0).otherwise((F.col("place") < F.col("bound")).cast("int"))
    out = sizes.join(small_side(plan), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).cast("long").alias("taken"),
                      *(["_copies", "_kept"] if keep else []))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix with the columns they came with, each as often as it is taken; empty texts go with size 0 once or not at all."""
    out = mix(docs, keep=docs.columns, **settings)
    return out.where("_copies > 0").select("_kept", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_kept.*")
