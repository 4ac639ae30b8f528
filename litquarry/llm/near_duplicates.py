"""Near-duplicate removal on wide SimHash fingerprints: the hierarchical index proposes pairs, shingle sets confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from litquarry.llm.common import bounded_batches, row_hash
from litquarry.llm.components import connected_components
from litquarry.llm.simhash import as_rows, by_key, fingerprints, forest, forests, group_pairs, near_groups, sampled_masks, shingle_hashes
from litquarry.scale import cut, small_side

SHINGLE = 5
SIMILARITY = 0.8
WIDTH = 4  # 64-bit words of a fingerprint
# At a similarity of 0.8 two fingerprints of 256 bits differ in 39 bits on average, with a deviation of 6; unrelated
# ones in 128. A pair of that kind agrees on 18 given bits with a chance of one in 19, so on one of 64 choices nearly always.
RADIUS = 62
TABLES, AGREEING = 64, 18
ALIKE = 0.848  # chance of one bit for such a pair
MEAN_GROUP = 512  # unrelated rows that share a choice of bits, at most
SET_BYTES = 1 << 25  # shingle sets of a group that are compared in one task


def mask_numbers(rows: int) -> tuple[int, int]:
    """(choices, bits of each) for ``rows`` fingerprints: more rows are told apart by more bits, at the same recall."""
    agreeing = max(AGREEING, math.ceil(math.log2(max(rows, 1) / MEAN_GROUP)))
    return math.ceil(TABLES * ALIKE ** (AGREEING - agreeing)), agreeing


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of ``texts``, which has node and text: the sorted hashes of the shingles as bytes."""
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [list(shingle_hashes(t, shingle)) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "shingles": [np.unique(np.concatenate(h)).tobytes() if h else b"" for h in own]})

    return cut(texts.mapInPandas(sets, "node binary, shingles binary").groupBy("node").agg(F.max("shingles").alias("shingles")))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (u, v) of ``pairs`` whose sets of shingles have a Jaccard similarity of ``similarity`` or more; two empty ones are alike."""
    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
        return pd.Series(out, dtype=float)

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("_su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("_sv")), "v")
    return both.where(jaccard("_su", "_sv") >= similarity).select("u", "v")


def untested(groups: DataFrame, radius: int) -> DataFrame:
    """Rows of ``groups`` (key, fp, node, component) in a near pair that lies between components and not in its group's forest."""
    def found(own: pd.DataFrame) -> pd.DataFrame:
        order, i, j, d = group_pairs(own["key"].to_numpy(), as_rows(own["fp"]), radius)
        label = np.unique(own["component"].to_numpy(), return_inverse=True)[1][order]
        open_ = label[i] != label[j]
        open_[forest(i, j, d, len(own))] = False
        return own.iloc[np.sort(order[np.unique(np.concatenate([i[open_], j[open_]]))])]

    return by_key(groups, found, "key long, fp binary, node binary, component binary")


def group_links(fp: np.ndarray, sets: list[np.ndarray], label: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows within ``radius`` bits and of ``similarity`` or more that join the components ``label`` as far as any do."""
    order, i, j, _ = group_pairs(np.zeros(len(fp), np.int64), fp, radius)
    i, j, label, size = order[i], order[j], label.copy(), np.array([len(x) for x in sets])
    near = (label[i] != label[j]) & (size[i] > 0) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
    i, j = i[near], j[near]
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    code, found = np.split(code, np.cumsum(size)[:-1]), []
    seen = np.zeros(sum(size) + 1, bool)
    for others in np.split(j, np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
        a, i = i[0], i[len(others):]
        others = others[label[others] != label[a]]
        if not len(others):
            continue
        seen[code[a]] = True
        both = np.add.reduceat(seen[np.concatenate([code[b] for b in others])], np.cumsum(np.append(0, size[others][:-1])), dtype=np.int64)
        seen[code[a]] = False
        for b in others[both / (size[a] + size[others] - both) >= similarity]:
            if label[b] != label[a]:
                found.append((a, b))
                label[label == label[b]] = label[a]
    return found


def links_between(groups: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(u, v): confirmed links that join components within each of ``groups`` (key, fp, node, component), all its near pairs compared.

    The sets of shingles are brought to the groups. A group with over SET_BYTES of them is cut into blocks, of which every two are compared.
    """
    rows = groups.join(sets, "node")
    blocks = rows.groupBy("key").agg(F.ceil(2 * F.sum(F.length("shingles")) / SET_BYTES).alias("_blocks"))
    blocks = blocks.select("key", F.when(F.col("_blocks") > 2, F.col("_blocks")).otherwise(F.lit(2).cast("long")).alias("_blocks"), (F.col("_blocks") <= 2).alias("_whole"))
    own = F.when(F.col("_whole"), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("fp"), F.col("_blocks")))
    other = F.when(F.col("_whole"), F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = groups.join(small_side(cut(blocks)), "key").withColumn("_own", own).withColumn("_other", F.explode(other)).where("_own != _other").select(
        F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "fp", "node", "component")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        node, label = own["node"].to_numpy(), np.unique(own["component"].to_numpy(), return_inverse=True)[1]
        found = group_links(as_rows(own["fp"]), [np.frombuffer(s, np.uint64) for s in own["shingles"]], label, radius, similarity)
        return pd.DataFrame({"u": [node[a] for a, _ in found], "v": [node[b] for _, b in found]})

    return dealt.join(sets, "node").groupBy("key").applyInPandas(run, "u binary, v binary")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of copies and near copies: that of the smallest doc_id, null last.

    Groups are the connected components of links between texts whose similarity is ``similarity`` or more. Rows
    equal in text are one node, so a large group of exact copies costs one row. First the lightest pairs of each group of
    the index are confirmed, then all its pairs between what that left apart. Documents without words form one
    group; of rows equal in all columns one stays. No row gives no row; all columns are kept, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    named = docs.withColumn("_nd_digest", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))).withColumn("_nd_row", row_hash(docs, names))
    facts = cut(fingerprints(named, shingle, WIDTH, True, ("doc_id", "_nd_digest", "_nd_row")))
    nodes = cut(facts.groupBy(F.col("_nd_digest").alias("node")).agg(
        F.min("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_nd_row").alias("row"))).alias("least")))
    leads = cut(nodes.groupBy("fp").agg(F.min("node").alias("lead")))
    tables, agreeing = mask_numbers(leads.count())
    groups = near_groups(leads, RADIUS, sampled_masks(tables, agreeing, 64 * WIDTH), WIDTH, exact=False)
    proposed = cut(forests(groups, RADIUS))
    pairs = proposed.where("a is not null").select("a", "b").distinct()
    side = lambda c, name: leads.select(F.col("fp").alias(c), F.col("lead").alias(name))
    same = nodes.join(leads, "fp").where(F.col("node") != F.col("lead")).select(F.col("lead").alias("u"), F.col("node").alias("v"))
    pairs = cut(pairs.join(side("a", "u"), "a").join(side("b", "v"), "b").select("u", "v").union(same))
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    one = cut(nodes.join(asked, "node").select(F.col("node").alias("_nd_digest"), F.col("least.row").alias("_nd_row")))
    texts = named.join(small_side(one), ["_nd_digest", "_nd_row"], "left_semi").select(F.col("_nd_digest").alias("node"), "text")
    sets = shingle_sets(texts, shingle)
    links = cut(confirmed(pairs, sets, similarity))
    classes = connected_components(links)
    more = cut(proposed.where("key is not null").select("key").distinct())
    if more.limit(1).count():  # a forest by bits may leave out true links where its own edges are not confirmed
        labelled = leads.join(classes, F.col("lead") == F.col("node"), "left").select("fp", F.col("lead").alias("node"), F.coalesce("component", "lead").alias("component"))
        rest = cut(untested(groups.join(small_side(more), "key", "left_semi").join(labelled, "fp").select("key", "fp", "node", "component"), RADIUS))
        if rest.limit(1).count():
            classes = connected_components(links.union(links_between(rest, sets, RADIUS, similarity)))
    grouped = nodes.join(classes, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    winners = grouped.groupBy("component").agg(F.min(F.struct("least", "node")).alias("w")).select(
        F.col("w.node").alias("_nd_digest"), F.col("w.least.row").alias("_nd_row"))
    rows = facts.groupBy("_nd_digest", "_nd_row").count()
    winners = cut(winners.join(rows, ["_nd_digest", "_nd_row"]))
    out = named.join(small_side(winners.where("count = 1")), ["_nd_digest", "_nd_row"], "left_semi")
    twins = winners.where("count > 1")
    if twins.limit(1).count():
        out = out.unionByName(named.join(small_side(twins), ["_nd_digest", "_nd_row"], "left_semi").dropDuplicates(["_nd_digest", "_nd_row"]))
    return out.select(*[F.col(f"`{c}`") for c in names])
