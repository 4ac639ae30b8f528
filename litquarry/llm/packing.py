"""Best-fit decreasing packing of token sequences, planned on the counts of each length and carried out in parallel.

Pieces of one length are alike to the packer, so it places counts, not pieces: a segment tree over the remaining
capacities finds the tightest open bins in logarithmic time, and a run of equal pieces fills them at once. The plan
is exactly what best-fit decreasing gives piece by piece, and its size is bounded by the capacity, not by the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from litquarry.llm.common import bounded_batches
from litquarry.llm.tokenise import encoder
from litquarry.scale import cut

CAPACITY = 4096
END = 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Capacities:
    """Segment tree over remaining capacities 0..n: a leaf is on while some open bin has that much room."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.on = [False] * (2 * self.size)

    def set(self, room: int, on: bool) -> None:
        at = room + self.size
        self.on[at] = on
        while at > 1:
            at >>= 1
            self.on[at] = self.on[2 * at] or self.on[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest room of an open bin that is at least ``need``."""
        at = need + self.size
        if self.on[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.on[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.on[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


@dataclass
class Run:
    """Pieces of one length with ranks from ``first``: ``each`` to a bin, bins numbered on from ``bin``, behind ``offset``."""
    length: int
    first: int
    each: int
    bin: int
    offset: int


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs that place ``counts[length]`` pieces of every length, and the number of bins. No count gives no bin."""
    tree, room, runs, bins = Capacities(capacity), {}, [], 0

    def leave(r: int, first: int, n: int) -> None:
        if n and r:
            room.setdefault(r, []).append((first, n))
            tree.set(r, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = room[r].pop()
                if not room[r]:
                    tree.set(r, False)
                each = r // length
            full = min(n, left // each)
            if full:
                runs.append(Run(length, rank, each, first, capacity - r))
                rank, left = rank + full * each, left - full * each
                leave(r - each * length, first, full)
            if full < n and left:  # the last pieces do not fill a bin as far as it could be
                runs.append(Run(length, rank, left, first + full, capacity - r))
                leave(r - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(r, first + full, n - full)
    return runs, bins


def cut_into_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs``, with the ``ids`` themselves if asked for.

    A null or empty text is the end id alone; only sequences over ``capacity`` are cut. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"]):
                raw = enc.encode(text if isinstance(text, str) else "") + tail
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)[:5 + with_ids])
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInPandas(run, PIECE + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: best-fit decreasing over all of them; no piece gives no row.

    Pieces of one length are ranked in about sqrt(n) hash buckets, so that a length that very many pieces share is
    spread over tasks. Equal rows may change places without effect. The driver sees one count per length.
    """
    pieces = cut(pieces)
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(length > capacity for length in counts):
        raise ValueError(f"a piece is longer than {capacity}")
    runs, _ = plan(counts, capacity)
    runs.sort(key=lambda r: (r.length, r.first))
    keys = np.array([(r.length << 44) + r.first for r in runs], np.int64)
    shared = spark.sparkContext.broadcast((keys, *(np.array([getattr(r, k) for r in runs], np.int64) for k in ("first", "each", "bin", "offset"))))
    buckets = max(1, int(sum(counts.values()) ** 0.5))
    own = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = own.groupBy("length", "_b").count()
    sums = sums.withColumn("_from", F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")).drop("count")
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(sums, ["length", "_b"]).withColumn("_rank", F.col("_from") + F.col("_n") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, first, each, bin_, offset = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = np.searchsorted(key, (length << 44) + rank, "right") - 1
        nth = rank - first[run]
        return pd.DataFrame({"sequence_id": bin_[run] + nth // each[run], "offset": offset[run] + nth % each[run] * length})

    return ranked.withColumn("_p", where("length", "_rank")).select(*pieces.columns, "_p.sequence_id", "_p.offset")
