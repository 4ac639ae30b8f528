"""Exact top-k by inner product with MaxScore over dimensions as terms.

Rows are dealt to shards of bounded size. A shard is kept as postings: one list per dimension, of its rows with a value
other than zero there (a list that most rows are in holds all of them in order), with its largest and smallest value. For
a query, a dimension can add at most its upper bound and at least its lower one; those with the widest spans are
essential: without them nothing reaches the score to beat. Only essential lists are traversed, those of queries with like
leading dimensions together; the other lists are probed, widest first, only for rows that can still compete. Every block of
queries first meets one shard; the k-th score there is the score to beat in all others, and the shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from litquarry.llm.common import bounded_batches
from litquarry.scale import cut

SHARD_ROWS = 16384
SHARD_VALUES = 1 << 24  # of all lists of a shard; shards of wide vectors have fewer rows
QUERY_ROWS = 1024
TOGETHER = 32  # queries that traverse lists together
BLOCKS_A_PART = 64  # blocks of queries that one copy of a shard serves
MOST_TASKS = 20_000
SEEDS = 64  # rows tried first in a shard to get a score to beat
STEP = 8  # dimensions probed between two checks
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(vectors: pd.Series, factor: int) -> np.ndarray:
    """Rows of floor(factor * x) as doubles, exact; shorter vectors end in zeros."""
    sizes = vectors.map(len)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all() and width:
        return np.floor(np.stack(vectors.to_list()).astype(np.float64) * factor)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = np.floor(np.asarray(v, np.float64) * factor)
    return out


class Postings(NamedTuple):
    """Rows of a shard by dimension: ``full`` has the lists of all rows, ``short`` (rows, values) of the others."""
    ids: np.ndarray
    full: np.ndarray  # lists of all rows, one below the other
    place: np.ndarray  # of a dimension in ``full``, or -1
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def width(self) -> int:
        return len(self.place)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest value of each dimension; a row that a list leaves out counts as zero."""
        low, high = np.zeros(self.width, self.full.dtype), np.zeros(self.width, self.full.dtype)
        whole = self.place >= 0
        low[whole], high[whole] = self.full[self.place[whole]].min(axis=1), self.full[self.place[whole]].max(axis=1)
        for d, (_, v) in self.short.items():
            low[d], high[d] = min(0, v.min()), max(0, v.max())
        return low, high

    def length(self, d: int) -> int:
        return len(self.ids) if self.place[d] >= 0 else len(self.short[d][0]) if d in self.short else 0

    def probe(self, dims: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Values of ``rows`` in ``dims``, one row of the result per dimension."""
        out = np.zeros((len(dims), len(rows)), self.full.dtype)
        whole = self.place[dims] >= 0
        out[whole] = self.full[np.ix_(self.place[dims[whole]], rows)]
        for i in np.flatnonzero(~whole):
            if dims[i] in self.short:
                at, v = self.short[dims[i]]
                found = np.minimum(np.searchsorted(at, rows), len(at) - 1)
                out[i] = np.where(at[found] == rows, v[found], 0)
        return out

    def traverse(self, weights: np.ndarray, dims: np.ndarray) -> np.ndarray:
        """Sums over the lists of ``dims`` for each row of ``weights``."""
        whole = dims[self.place[dims] >= 0]
        total = weights[:, whole] @ self.full[self.place[whole]]
        for d in dims:
            if d in self.short:
                at, v = self.short[d]
                total[:, at] += weights[:, d, None] * v
        return total

    def extremes(self, d: int, largest: bool, k: int) -> np.ndarray:
        """About ``k`` rows with the largest or smallest values in a dimension."""
        at, v = (np.arange(len(self.ids)), self.full[self.place[d]]) if self.place[d] >= 0 else self.short.get(d, (np.zeros(0, int),) * 2)
        return at if len(at) <= k else at[np.argpartition(-v if largest else v, k)[:k]]


def postings(ids: np.ndarray, rows: np.ndarray) -> Postings:
    """Lists by dimension of a matrix of rows."""
    n, width = rows.shape
    used = np.count_nonzero(rows, axis=0)
    whole = np.flatnonzero((4 * used > n) & (n > 0))
    place = np.full(width, -1)
    place[whole] = np.arange(len(whole))
    short = {int(d): (at, rows[at, d]) for d in np.flatnonzero((place < 0) & (used > 0)) for at in [np.flatnonzero(rows[:, d])]}
    return Postings(ids, np.ascontiguousarray(rows[:, whole].T), place, short)


def _packed(m: np.ndarray) -> tuple[str, bytes]:
    for kind in ("<i2", "<i4"):
        if m.size == 0 or np.abs(m).max() <= np.iinfo(kind).max:
            return kind, m.astype(kind).tobytes()
    return "<f8", m.astype("<f8").tobytes()


def _blocks(vectors: DataFrame, factor: int, rows: int, count: int, lists: bool) -> DataFrame:
    """Rows packed into about ``count`` / ``rows`` blocks by a hash of the id: number, ids, number type, values.

    Values are the matrix, row by row, or with ``lists`` the postings: places of full lists, lengths and rows of short ones.
    """
    blocks = max(1, -(-count // rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids, m = pdf["vec_id"].to_numpy("<i8"), _matrix(pdf["embedding"], factor)
        width, place, at = m.shape[1], b"", b""
        if lists:
            p = postings(ids, m)
            own = [p.short[d] for d in sorted(p.short)]
            sizes = np.array([-1 if p.place[d] >= 0 else p.length(d) for d in range(width)], "<i4")  # -1: all rows
            m = np.concatenate([p.full.ravel(), *[v for _, v in own]])
            place, at = sizes.tobytes(), np.concatenate([np.zeros(0, "<i4"), *[a.astype("<i4") for a, _ in own]]).astype("<i4").tobytes()
        kind, data = _packed(m)
        return pd.DataFrame({"number": [pdf["_block"].iloc[0]], "ids": [ids.tobytes()], "kind": [kind], "width": [width], "sizes": [place], "at": [at], "data": [data]})

    dealt = vectors.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(run, "number long, ids binary, kind string, width int, sizes binary, at binary, data binary")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, "<i8")
    return ids, np.frombuffer(row.data, row.kind).astype(np.float64).reshape(len(ids), row.width)


def _unpacked_lists(row) -> Postings:
    ids, sizes = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.sizes, "<i4")
    values, at = np.frombuffer(row.data, row.kind).astype(np.float64), np.frombuffer(row.at, "<i4")
    whole = np.flatnonzero(sizes < 0)
    place = np.full(len(sizes), -1)
    place[whole] = np.arange(len(whole))
    split = len(whole) * len(ids)
    short, a = {}, 0
    for d in np.flatnonzero(sizes > 0):
        b = a + sizes[d]
        short[int(d)] = (at[a:b], values[split + a:split + b])
        a = b
    return Postings(ids, values[:split].reshape(len(whole), len(ids)), place, short)


def search_shard(query_ids: np.ndarray, queries: np.ndarray, shard: Postings, k: int, beat: np.ndarray | None = None,
                 traversed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the ``k`` best rows of a shard for each query, ties to the smaller id.

    ``beat`` has scores that ``k`` other rows reach already: lower ones are left out. ``traversed`` is told how many
    postings the essential lists had, query by query.
    """
    if not len(queries) or not len(shard.ids):
        return (np.zeros(0, np.int64),) * 3
    if queries.shape[1] < shard.width:
        queries = np.pad(queries, ((0, 0), (0, shard.width - queries.shape[1])))
    width = shard.width  # dimensions behind a shard's width add nothing
    least, most = shard.bounds()
    with np.errstate(over="ignore"):
        limit = float(np.abs(queries).sum(axis=1).max() * max(np.abs(least).max(initial=0), np.abs(most).max(initial=0)))
    if limit >= 2 ** 53:
        return _search_large(query_ids, queries, shard, k)
    queries = queries[:, :width]
    if limit < 2 ** 24:  # then single precision is exact
        queries, least, most = queries.astype(np.float32), least.astype(np.float32), most.astype(np.float32)
        shard = shard._replace(full=shard.full.astype(np.float32), short={d: (a, v.astype(np.float32)) for d, (a, v) in shard.short.items()})
    every = np.arange(width)
    high, low = np.maximum(queries * most, queries * least), np.minimum(queries * most, queries * least)
    order = np.argsort(low - high, axis=1, kind="stable")  # widest span first
    threshold = np.full(len(queries), -np.inf) if beat is None else beat.astype(np.float64).copy()

    def raise_by(i: int, some: np.ndarray) -> None:
        """The k-th score among ``some`` rows, scored in full, is a score to beat."""
        scores = (queries[i] @ shard.probe(every, some))[shard.ids[some] != query_ids[i]]
        if len(scores) >= k:
            threshold[i] = max(threshold[i], np.partition(scores, len(scores) - k)[len(scores) - k])

    if width:
        for i in np.flatnonzero(np.isneginf(threshold)):
            d = order[i, 0]
            raise_by(i, shard.extremes(d, queries[i, d] > 0, SEEDS))
    # essential: the widest dimensions, until the rest together cannot lift the least possible score to the threshold
    span = np.take_along_axis(high - low, order, axis=1)
    rest = np.cumsum(span[:, ::-1].astype(np.float64), axis=1)[:, ::-1]  # span of this dimension and all behind it
    essential = (rest >= (threshold - low.sum(axis=1))[:, None]).sum(axis=1)
    first = order[:, 0] if width else np.zeros(len(queries), int)
    alike = np.lexsort((essential, queries[np.arange(len(queries)), first] > 0 if width else first, first))
    lengths = np.array([shard.length(d) for d in every], np.int64)
    out = []
    for start in range(0, len(alike), TOGETHER):
        group = alike[start:start + TOGETHER]
        lists = np.unique(np.concatenate([order[i, :essential[i]] for i in group])) if width else every
        partial = shard.traverse(queries[group], lists)
        if traversed is not None:
            traversed.append(int(lengths[lists].sum()) * len(group))
        for g, i in enumerate(group):
            others = order[i][~np.isin(order[i], lists)]
            ahead = np.concatenate([np.cumsum(high[i, others][::-1].astype(np.float64))[::-1], [0.0]])  # most that the lists from here on add
            some = np.argpartition(partial[g], len(shard.ids) - SEEDS)[-SEEDS:] if len(shard.ids) > SEEDS else np.arange(len(shard.ids))
            raise_by(i, some)
            alive = np.flatnonzero(partial[g] + ahead[0] >= threshold[i])
            score = partial[g][alive].astype(np.float64)
            for a in range(0, len(others), STEP):
                dims = others[a:a + STEP]
                score = score + queries[i, dims] @ shard.probe(dims, alive)
                near = score + ahead[min(a + STEP, len(others))] >= threshold[i]
                alive, score = alive[near], score[near]
            other = shard.ids[alive] != query_ids[i]
            best_ids, best_scores = _best(shard.ids[alive[other]], score[other], k)
            out.append((np.full(len(best_ids), i), best_ids, best_scores))
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return ids[order], np.array([int(s) for s in score[order]], np.int64)


def _search_large(query_ids, queries, shard, k):
    """Values too large for doubles: whole numbers of any size; a score past 64 bits counts as the end of that range."""
    rows = shard.probe(np.arange(shard.width), np.arange(len(shard.ids))).T
    big_q, big_r = ([[int(x) for x in row] for row in m] for m in (queries, rows))
    out = []
    for i, q in enumerate(big_q):
        scored = sorted((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(q, r)))), j) for r, j in zip(big_r, shard.ids.tolist()) if j != query_ids[i])[:k]
        out += [(i, j, -s) for s, j in scored]
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _meet(shards: DataFrame, meetings: DataFrame, groups: int, k: int) -> DataFrame:
    """The ``k`` best of each shard for the queries of the blocks that meet it; ``meetings`` has shard, part and ``beat``.

    A shard is sent once to each part of the blocks and stays in its task, while these stream past it.
    """
    columns = ["number", "ids", "kind", "width", "sizes", "at", "data"]
    nothing = F.array().cast("array<double>").alias("beat")
    asked = meetings.select("shard", "part", F.lit(1).alias("side"), *columns, "beat")
    sent = asked.select("shard", "part").distinct().join(shards.withColumn("shard", F.col("number")), "shard").select("shard", "part", F.lit(0).alias("side"), *columns, nothing)
    dealt = sent.unionByName(asked).repartition(max(1, min(groups, MOST_TASKS)), "shard", "part").sortWithinPartitions("shard", "part", "side", "number")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.side == 0:
                    shard = _unpacked_lists(row)
                    continue
                query_ids, q = _unpacked(row)
                number, found, score = search_shard(query_ids, q, shard, k, np.array(row.beat, np.float64) if len(row.beat) else None)
                yield pd.DataFrame({"block": row.number, "place": number, "query_id": query_ids[number], "vec_id": found, "score": score})

    return dealt.mapInPandas(run, "block long, place long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, factor: int = 64, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows for each row of (vec_id, embedding) with ``is_query``.

    Scores are inner products of floor(factor * x); ties go to the smaller vec_id. Vectors that are null or hold a
    null or non-finite component, and rows without an id, take no part; a shorter vector counts as zeros behind its
    end. A repeated id is not a candidate for itself; each of its rows is a query and a candidate otherwise. An empty
    table gives no row. Work grows with queries times rows, in blocks of bounded size that any task can hold; what is
    shuffled is each block once per shard and each shard once per BLOCKS_A_PART blocks.
    """
    bounded_batches(vectors.sparkSession)
    own = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))))
    asked = own.where(is_query)
    m = asked.count()
    n, width = own.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    shard_rows = max(1, min(shard_rows, SHARD_VALUES // max(1, width)))
    lists = cut(_blocks(own, factor, shard_rows, n, lists=True))
    queries = cut(_blocks(asked, factor, query_rows, m, lists=False))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    part = F.floor(F.col("number") / BLOCKS_A_PART)
    home = F.pmod(F.col("number"), F.lit(shards))
    # every block meets its home shard first
    unknown = F.array().cast("array<double>")
    first = cut(_meet(lists, queries.withColumn("shard", home).withColumn("part", part).withColumn("beat", unknown), blocks, k))
    kth = first.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    known = kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("score").cast("double")))).alias("_known"))
    # a query without k rows in its home shard has nothing to beat yet
    places = F.sequence(F.lit(0).cast("long"), (F.length("ids") / 8).cast("long") - 1)
    beat = F.transform(places, lambda i: F.coalesce(F.col("_known")[i], F.lit(float("-inf"))))
    rest = queries.join(known, queries["number"] == known["block"], "left").withColumn("beat", beat).withColumn("part", part).withColumn("home", home)
    rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where(F.col("shard") != F.col("home"))
    found = first.unionByName(_meet(lists, rest, shards * -(-blocks // BLOCKS_A_PART), k)) if shards > 1 else first
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
