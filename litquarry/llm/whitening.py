"""Embedding whitening: exact covariances by polarisation, eigenvectors on the driver, projection in the tasks.

The variance of every dimension and of the sum of every two dimensions is aggregated over all rows as exact whole
numbers; cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. Values are centred before they are squared: by the whole number
next to the mean in the tasks, and by what the mean differs from it, again exactly, when the sums are put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SHIFT = 1_000_000
SCALE = 64
COMPONENTS = 32
LIMIT = 1 << 62  # entries beyond are held there
MAX_DIMENSIONS = 8192  # what the driver holds grows with the square of the dimensions, never with the rows
_BLOCK = 512  # rows whose pair sums are squared at once
_LIMB = 10 ** 18
_NARROW = 1 << 24  # centred entries below go the way of 64-bit numbers, others of whole numbers of any size


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of every dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one component per column
    explained: np.ndarray  # share of the trace

    @property
    def usable(self) -> np.ndarray:
        """Components along which the rows differ at all."""
        return self.values > len(self.values) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): every entry as floor(64 c) + 1000000, without rows whose vector is null, empty or not all finite.

    Rows whose vector has another length than most rows (ties: than the longest of these) can share no
    covariance with the others and are left out, too.
    """
    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_e"))
    own = own.where(F.col("_e").isNotNull() & (F.size("_e") > 0) & ~F.exists("_e", bad))
    lengths = own.groupBy(F.size("_e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the covariances of at most {MAX_DIMENSIONS} are put together on the driver")
    held = lambda c: F.least(F.greatest(F.floor(c * float(SCALE)), F.lit(-LIMIT)), F.lit(LIMIT)) + F.lit(SHIFT)
    return own.where(F.size("_e") == d).select("vec_id", F.transform("_e", held).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact_sums(rows: DataFrame, sums_of) -> list[int]:
    """Sums over all rows of the whole numbers that ``sums_of(matrix)`` gives for blocks of rows; one per place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch)
            for at in range(0, len(x), _BLOCK):
                part = [int(v) for v in sums_of(x[at:at + _BLOCK])]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total:
            # two parts of at most 38 digits each, as sums of squares pass 64 bits
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(v // _LIMB) for v in total]),
                                              pa.array([v % _LIMB for v in total], pa.int64())], ["k", "hi", "lo"])

    parts = rows.select("x").mapInArrow(run, "k int, hi string, lo long")
    added = parts.groupBy("k").agg(F.sum(F.col("hi").cast("decimal(38,0)")).alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo"))
    return [int(r["hi"]) * _LIMB + int(r["lo"]) for r in sorted(added.collect(), key=lambda r: r["k"])]


def _squares(z: np.ndarray) -> Iterator[int]:
    """Sums of squares of every dimension and of every later dimension added to it: (0), (0+1), (0+2), ..., (1), (1+2), ..."""
    wide = z if z.dtype != object and np.abs(z).max(initial=0) < _NARROW else z.astype(object)
    for i in range(z.shape[1]):
        pairs = wide[:, i:] + wide[:, i:i + 1]
        pairs[:, 0] = wide[:, i]
        yield from (pairs * pairs).sum(axis=0)


def fit(rows: DataFrame) -> Whitening:
    """Covariances, eigenvalues and eigenvectors over all rows of ``whole_vectors``; no row gives no component.

    The driver receives d (d + 3) / 2 + d numbers for d dimensions. Every task adds up its own rows, so one
    vector that a third of the rows share changes nothing.
    """
    sums = _exact_sums(rows, lambda x: (x.sum(axis=0) if np.abs(x).max(initial=0) < 1 << 50 else x.astype(object).sum(axis=0)))
    n, d = rows.count() if sums else 0, len(sums)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    near = [s // n for s in sums]
    rest = [n * c - s for c, s in zip(near, sums)]  # n x - S = n (x - near) + rest
    centre = np.array(near, object)

    def centred(x: np.ndarray) -> np.ndarray:
        small = np.abs(x).max(initial=0) < 1 << 61 and max(map(abs, near)) < 1 << 61
        return x - centre.astype(np.int64) if small else x.astype(object) - centre

    squares = _exact_sums(rows, lambda x: _squares(centred(x)))
    firsts = [s - n * c for s, c in zip(sums, near)]  # sums of the centred values
    exact, at = {}, 0
    for i in range(d):
        for j in range(i, d):
            r, f = (rest[i], firsts[i]) if i == j else (rest[i] + rest[j], firsts[i] + firsts[j])
            exact[i, j] = n * n * squares[at] + 2 * n * r * f + n * r * r  # sum of (n x - S) ** 2
            at += 1
    covariance = np.zeros((d, d))
    for i in range(d):
        covariance[i, i] = exact[i, i] / n ** 3
        for j in range(i + 1, d):
            covariance[i, j] = covariance[j, i] = (exact[i, j] - exact[i, i] - exact[j, j]) / (2 * n ** 3)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), np.ascontiguousarray(vectors[:, ::-1])
    trace = covariance.trace()
    return Whitening(n, sums, values, vectors, values / trace if trace > 0 else np.zeros(d))


def _projected(rows: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, whitened): the exact squared distance from the mean times n, and the components over their spread."""
    n, k = model.n, min(components, len(model.values))
    near = [s // n for s in model.sums] if n else []
    rest = [s - n * c for s, c in zip(model.sums, near)]
    scale = np.where(model.usable[:k], np.sqrt(np.where(model.usable[:k], model.values[:k], 1.0)), np.inf) if n else np.zeros(0)
    basis, part = model.vectors[:, :k], np.array([r / n for r in rest]) if n else np.zeros(0)
    top = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            if not len(x):
                continue
            z = x.astype(object) - np.array(near, object) if np.abs(x).max() >= 1 << 61 else x - np.array(near, np.int64)
            widest = int(np.abs(z).max()) + 1
            if z.dtype != object and z.shape[1] * (n * widest) ** 2 < top:
                y = n * z - np.array(rest, np.int64)
                deviation = (y * y).sum(axis=1)
            else:
                deviation = np.array([min(top, sum((n * int(a) - r) ** 2 for a, r in zip(row, rest))) for row in z], np.int64)
            whitened = (z.astype(np.float64) - part) @ basis / scale
            flat = pa.array(whitened.reshape(-1), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32) if k else np.zeros(len(x) + 1, np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, model: Whitening, components: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows.

    Components along which no rows differ cannot be whitened and are left out.
    """
    k = min(components, len(model.values))
    if not model.n or not model.usable[:k].any():
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _matrix(batch, "whitened")
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["k", "v"])

    sums = projected.select("whitened").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.array([r["v"] for r in sorted(sums, key=lambda r: r["k"])]).reshape(k + 1, k) / model.n
    own = model.usable[:k]
    covariance = total[1:] - np.outer(total[0], total[0])
    return float(np.abs(covariance - np.eye(k))[np.ix_(own, own)].max())


def whiten(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """One row per row of ``rows`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Repeated rows give repeated results, a null vec_id stays null. ``deviation`` past 64 bits counts as the end of that
    range. Along a component without any spread (one row, equal rows, fewer rows than dimensions) ``whitened`` is 0.
    """
    projected = _projected(rows, model, components)
    k = min(components, len(model.values))
    shares = F.array(*[F.lit(float(v)) for v in model.explained[:k]]) if k else F.array().cast("array<double>")
    error = identity_error(projected, model, components)
    out = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return out.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error"))
