"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length a table states."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from litquarry.llm.common import bounded_batches, clean_labels, held_out, labelled_sample
from litquarry.llm.features import STATS, words_and_structure
from litquarry.llm.textvec import sigmoid

BUCKETS = 1 << 14
BINS = 12  # of each statistic, by quantiles of the sample
RANK = 8
PER_CLASS = 3000  # labelled documents of each class to fit on, about
THRESHOLD = 0.7
FEATURES = len(STATS) + 1  # and the stated length


@dataclass
class Machine:
    """Weights of a factorisation machine; ``edges`` cut each statistic into bins, which follow the word buckets."""
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Logit per row. Pairwise terms take linear time: half of the squared sum less the sum of squares, per factor."""
        z = self.bias + np.bincount(row, weights=self.linear[column] * value, minlength=n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[column, f] * value
            z += 0.5 * (np.bincount(row, weights=vx, minlength=n) ** 2 - np.bincount(row, weights=vx * vx, minlength=n))
        return z


def raw_features(texts: pd.Series, stated: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word entries (row, bucket, share of the text's words) and the statistics; a null stated length is the text's own."""
    doc, bucket, count, stats = words_and_structure(texts, BUCKETS)
    own = texts.map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy(float)
    said = pd.to_numeric(stated, errors="coerce").to_numpy(float)
    stats = np.column_stack([stats, np.log1p(np.maximum(np.where(np.isnan(said), own, said), 0))])
    share = count / np.maximum(np.bincount(doc, weights=count, minlength=len(texts)), 1)[doc]
    return doc, bucket, np.sqrt(share), stats


def entries(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: word shares, and a one in the bin of each statistic."""
    n, m = stats.shape
    bins = np.stack([np.searchsorted(edges[j], stats[:, j], "right") for j in range(m)], axis=1)
    column = (BUCKETS + np.arange(m) * (BINS + 1) + bins).astype(np.int32)
    return (np.concatenate([doc, np.repeat(np.arange(n, dtype=np.int32), m)]), np.concatenate([bucket, column.ravel()]),
            np.concatenate([value, np.ones(n * m, np.float32)]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = 12, seed: int = 7) -> Machine:
    """Fit on about ``per_class`` labelled documents of each class outside the held-out share.

    The sample is bounded, so its sparse rows fit the driver (about 200 words a document). The bias is shifted from
    the sample's class shares to those of all labels. Without both classes the machine scores everything alike.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select("doc_id", "text", F.col("n_chars").alias("stated") if "n_chars" in docs.columns else F.lit(None).cast("long").alias("stated"))
    sample = labelled_sample(own, labels, "quality", {0: per_class, 1: per_class})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, bucket, value, stats = raw_features(pdf["text"], pdf["stated"])
            at = np.searchsorted(doc, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "stats": list(stats), "bucket": [bucket[a:b] for a, b in zip(at, at[1:])],
                                "value": [value[a:b] for a, b in zip(at, at[1:])]})

    rows = sample.select("doc_id", "label", "text", "stated").mapInPandas(
        run, "doc_id long, label int, stats array<double>, bucket array<int>, value array<float>").toPandas().sort_values("doc_id", kind="stable")
    counts = {r["label"]: r["count"] for r in clean_labels(labels, "quality").groupBy("label").count().collect()}
    rng = np.random.default_rng(seed)
    size = BUCKETS + FEATURES * (BINS + 1)
    if len(rows) == 0 or rows["label"].nunique() < 2:
        known = counts.get(1, 0) + counts.get(0, 0)
        return Machine(np.zeros((FEATURES, BINS)), float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))) if known else 0.0, np.zeros(size), np.zeros((size, RANK)))
    stats = np.array(rows["stats"].tolist())
    edges = np.quantile(stats, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T
    lengths = rows["bucket"].map(len).to_numpy()
    row, column, value = entries(np.repeat(np.arange(len(rows), dtype=np.int32), lengths), np.concatenate(rows["bucket"].tolist()),
                                 np.concatenate(rows["value"].tolist()), stats, edges)
    y = rows["label"].to_numpy(float)
    n, rows = len(rows), None
    order = np.argsort(row, kind="stable")
    row, column, value = row[order], column[order], value[order]
    starts = np.searchsorted(row, np.arange(n + 1))
    m = Machine(edges, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    grad_linear, grad_factors, grad_bias = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 128)):
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch])
            r = np.repeat(np.arange(len(batch)), starts[batch + 1] - starts[batch])
            c, x = column[at], value[at]
            vx = m.factors[c] * x[:, None]
            sums = np.stack([np.bincount(r, weights=vx[:, f], minlength=len(batch)) for f in range(RANK)], axis=1)
            error = sigmoid(m.score(r, c, x, len(batch))) - y[batch]
            e = error[r] * x
            seen, where = np.unique(c, return_inverse=True)
            gl = np.bincount(where, weights=e) + 1e-3 * m.linear[seen]
            pair = e[:, None] * (sums[r] - vx)
            gf = np.stack([np.bincount(where, weights=pair[:, f]) for f in range(RANK)], axis=1) + 1e-2 * m.factors[seen]
            grad_linear[seen] += gl ** 2
            grad_factors[seen] += gf ** 2
            grad_bias += error.sum() ** 2
            m.linear[seen] -= 0.2 * gl / np.sqrt(grad_linear[seen])
            m.factors[seen] -= 0.05 * gf / np.sqrt(grad_factors[seen])
            m.bias -= 0.2 * error.sum() / np.sqrt(grad_bias)
    m.bias += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return m


def score_column(docs: DataFrame, machine: Machine) -> Column:
    """The score of each row of ``docs``, from its text and, where there is one, its n_chars."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # about 1.2 MB whatever the data

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, stated in batches:
            m = shared.value
            rows = entries(*raw_features(texts.reset_index(drop=True), stated), m.edges)
            yield pd.Series(sigmoid(m.score(*rows, len(texts))))

    return run(F.col("text"), F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long"))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null text is empty, and an empty one has a score from its statistics. Repeated rows give repeated results. Only
    text and, where there is one, n_chars are inputs; other columns are not read.
    """
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs, machine).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
