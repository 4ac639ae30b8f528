"""Order-dependent scans over groups of any size, in bounded blocks.

A scan carries a small state from row to row. Groups of at most a block's rows stream through sorted partitions. A longer
group is cut into blocks of consecutive rows; a block says, for every state it may be entered with, which state it
leaves. These functions are put together FAN by FAN, level by level, until one is left; then the states in which
the blocks are entered are handed back down the same levels. No task ever holds more than a block or FAN functions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from litquarry.scale import cut, global_rank, small_side

BLOCK = 4096
FAN = 32
_LINK = "_in array<long>, _out array<long>, _add array<long>"


# ---- composing block functions -------------------------------------------------------------------

def runs(states: Iterable[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Step function over (entry, exit, increment), sorted by entry: first entry of each run, its exit and increment."""
    first, out, add = [], [], []
    for entry, leave, more in states:
        if not out or out[-1] != leave or add[-1] != more:
            first.append(entry)
            out.append(leave)
            add.append(more)
    return first, out, add


def _applied(link: tuple, state: int) -> tuple[int, int]:
    first, out, add = link
    i = bisect_right(first, state) - 1
    return out[i], add[i]


def _composed(links: list[tuple]) -> tuple[list[int], list[int], list[int]]:
    first, out, add = (np.asarray(x, np.int64) for x in links[0])
    for nxt in links[1:]:
        at = np.searchsorted(np.asarray(nxt[0], np.int64), out, "right") - 1
        out, add = np.asarray(nxt[1], np.int64)[at], add + np.asarray(nxt[2], np.int64)[at]
    return runs(zip(first.tolist(), out.tolist(), add.tolist()))


def entry_states(links: DataFrame, group: list[str], start: int, fan: int = FAN) -> DataFrame:
    """(group, _b, _entry, _count): the state each block is entered in, and the increments of the blocks before it.

    ``links(group, _b from 0 without gaps, _in, _out, _add)`` holds one step function per block; the first one of a
    group is entered in ``start``. Group columns hold no null. Levels grow with the logarithm of the blocks.
    """
    fields = T.StructType([links.schema[g] for g in group])
    levels = [cut(links.select(*group, F.col("_b").cast("long").alias("_b"), "_in", "_out", "_add"))]
    upper = F.floor(F.col("_b") / fan)
    while levels[-1].agg(F.max("_b")).first()[0]:
        def join_up(pdf):
            pdf = pdf.sort_values("_b")
            link = _composed(list(zip(pdf["_in"], pdf["_out"], pdf["_add"])))
            return pdf.iloc[:1].assign(_b=pdf["_u"], _in=[link[0]], _out=[link[1]], _add=[link[2]])[[*group, "_b", "_in", "_out", "_add"]]

        grouped = levels[-1].withColumn("_u", upper).groupBy(*group, "_u")
        levels.append(cut(grouped.applyInPandas(join_up, T.StructType(fields.fields + links.sparkSession.createDataFrame([], f"_b long, {_LINK}").schema.fields))))
    entries = levels[-1].select(*group, "_b", F.lit(start).cast("long").alias("_entry"), F.lit(0).cast("long").alias("_count"))
    for below in reversed(levels[:-1]):
        def hand_down(pdf):
            pdf = pdf.sort_values("_b")
            state, count, out = int(pdf["_entry"].iloc[0]), int(pdf["_count"].iloc[0]), []
            for link in zip(pdf["_in"], pdf["_out"], pdf["_add"]):
                out.append((state, count))
                state, more = _applied(link, state)
                count += int(more)
                state = int(state)
            return pdf[[*group, "_b"]].assign(_entry=[o[0] for o in out], _count=[o[1] for o in out])

        children = below.withColumn("_u", upper).join(entries.withColumnRenamed("_b", "_u"), [*group, "_u"])
        entries = children.groupBy(*group, "_u").applyInPandas(hand_down, T.StructType(
            fields.fields + links.sparkSession.createDataFrame([], "_b long, _entry long, _count long").schema.fields))
    return cut(entries)


# ---- scans over rows -----------------------------------------------------------------------------

def _by_group(keys: list[str], work: Callable[[dict[str, list]], Iterable[tuple]], schema: T.StructType):
    """Arrow batches sorted by ``keys`` to output rows of ``work``, called with the columns of one group at a time."""
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] | None = None
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            if held:
                cols = {n: held[n] + v for n, v in cols.items()}
            ids = list(zip(*(cols[k] for k in keys)))
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            out: list[tuple] = []
            for a, b in zip(edges[:-2], edges[1:-1]):
                out.extend(work({n: v[a:b] for n, v in cols.items()}))
            held = {n: v[edges[-2]:] for n, v in cols.items()} if ids else None
            yield from written(out)
        if held:
            yield from written(list(work(held)))

    def written(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 10_000):
            part = list(zip(*rows[at:at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, out_schema)], schema=out_schema)

    return run


def _sorted_by(df: DataFrame, *keys: str, then: list[Column | str]) -> DataFrame:
    """A number of partitions that adaptive execution leaves alone, as the work grows with rows rather than bytes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *then)


def blocked_scan(rows: DataFrame, group: list[str], order: list[Column | str],
                 summarise: Callable[[dict[str, list], int], Iterable[tuple[int, int, int]]],
                 emit: Callable[[dict[str, list], int, int, int], Iterable[tuple]], schema: T.StructType, start: int,
                 block: int = BLOCK, halo: int = 0) -> DataFrame:
    """Run a scan over ``rows`` in ``order`` inside each ``group``; a null in a group column is a value like others.

    ``summarise(columns, own)`` yields (entry state, exit state, increment) by rising entry state for a block whose first ``own``
    rows are its own and whose rest is up to ``halo`` rows of look-ahead. ``emit(columns, own, entry, counter)`` gives the output
    rows; the column ``pos`` counts rows of the group from 1. A group of at most ``block`` rows is one block.
    """
    block = max(block, 1)
    keyed = rows.withColumn("_g", F.to_json(F.struct(*group)))
    long_groups = cut(keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("_g"))
    some = not long_groups.isEmpty()
    marked = small_side(long_groups)

    def whole(cols: dict[str, list]) -> Iterable[tuple]:
        cols["pos"] = range(1, len(cols["_g"]) + 1)
        return emit(cols, len(cols["_g"]), start, 0)

    short = keyed.join(marked, "_g", "left_anti") if some else keyed
    out = _sorted_by(short, "_g", then=order).mapInArrow(_by_group(["_g"], whole, schema), schema)
    if not some:
        return out

    ranked = global_rank(keyed.join(marked, "_g", "left_semi"), ["_g"], order, "pos")
    own_block = F.floor((F.col("pos") - 1) / block)
    homes = F.array(own_block)
    if halo:  # a row also stands behind every block that looks ahead to it
        homes = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("pos") - 1 - halo) / block)), own_block)
    placed = ranked.withColumn("_own", own_block).withColumn("_b", F.explode(homes))
    placed = cut(_sorted_by(placed, "_g", "_b", then=["pos"]))
    link = T.StructType([T.StructField("_g", T.StringType()), T.StructField("_b", T.LongType())] + [
        T.StructField(n, T.ArrayType(T.LongType())) for n in ("_in", "_out", "_add")])

    def own_rows(cols: dict[str, list]) -> int:
        return sum(o == b for o, b in zip(cols["_own"], cols["_b"]))

    def summary(cols: dict[str, list]) -> Iterable[tuple]:
        yield (cols["_g"][0], cols["_b"][0], *runs(summarise(cols, own_rows(cols))))

    def entered(cols: dict[str, list]) -> Iterable[tuple]:
        return emit(cols, own_rows(cols), cols["_entry"][0], cols["_count"][0])

    entries = entry_states(placed.mapInArrow(_by_group(["_g", "_b"], summary, link), link), ["_g"], start)
    ready = _sorted_by(placed.join(small_side(entries), ["_g", "_b"]), "_g", "_b", then=["pos"])
    return out.unionByName(ready.mapInArrow(_by_group(["_g", "_b"], entered, schema), schema))


def jump_summary(jumps: Callable[[dict[str, list], int], Callable[[int], int]], reach: int):
    """Summary of a scan whose state is "next start, counted from the block's first row".

    ``jumps(columns, own)`` returns the function start -> next start. An entry lies within ``reach``.
    """
    def summarise(cols: dict[str, list], own: int):
        step = jumps(cols, own)
        exit_of: dict[int, tuple[int, int]] = {}
        for s in range(own - 1, -1, -1):
            nxt = step(s)
            exit_of[s] = (nxt - own, 1) if nxt >= own else (exit_of[nxt][0], exit_of[nxt][1] + 1)
        for s in range(min(reach, own)):
            yield s, exit_of[s][0], exit_of[s][1]
        # a start that lies beyond this block is handed on unchanged
        for s in range(own, reach + 1):
            yield s, s - own, 0
    return summarise
