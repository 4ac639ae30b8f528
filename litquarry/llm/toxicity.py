"""Toxicity by a classifier chain: categories in turn, each linear model also reading the earlier ones' probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from litquarry.llm.common import bounded_batches, clean_labels, held_out, labelled_sample
from litquarry.llm.features import word_counts
from litquarry.llm.textvec import sigmoid

BUCKETS = 1 << 20
PER_CLASS = {1: 5000, 0: 10000}  # labelled documents to fit on, about
FOLDS = 5
THRESHOLD = 0.5
MIN_DOCUMENTS, MIN_Z = 5, 4.5
# The table marks documents as toxic only. A category's label is that mark on a document with one of its words; the
# models see no list, only hashed words.
CATEGORIES: dict[str, Sequence[str]] = {
    "insult": ("clown", "fool", "idiot", "loser", "moron", "scum", "stupid"),
    "contempt": ("disgusting", "pathetic", "trash", "useless", "worthless"),
    "toxic": (),
}


@dataclass
class Link:
    """One linear model of the chain: weights of the buckets the sample had, of the earlier probabilities, and a bias.

    ``shift`` takes a probability from the sample's share of toxic documents to that of all labels. Later links learned
    from unshifted probabilities and read those; only what is returned is shifted.
    """
    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    shift: float = 0.0


def _train(row: np.ndarray, column: np.ndarray, earlier: np.ndarray, y: np.ndarray, size: int, rounds: int = 120) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch adaptive gradient steps; a word counts once a document, however often it comes.

    Only buckets in MIN_DOCUMENTS or more documents whose share of positive ones lies MIN_Z deviations from the average
    take part: the other words of the few positive documents would be learned by heart.
    """
    share, seen = y.mean(), np.bincount(column, minlength=size)
    z = (np.bincount(column, weights=y[row], minlength=size) - seen * share) / np.sqrt(seen * share * (1 - share) + 1e-9)
    part = ((seen >= MIN_DOCUMENTS) & (np.abs(z) >= MIN_Z))[column]
    row, column = row[part], column[part]
    w, v, bias = np.zeros(size), np.zeros(earlier.shape[1]), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    gw, gv, gb = np.full(size, 1e-8), np.full(len(v), 1e-8), 1e-8
    for _ in range(rounds):
        error = sigmoid(bias + np.bincount(row, weights=w[column], minlength=len(y)) + earlier @ v) - y
        dw = np.bincount(column, weights=error[row], minlength=size) + 0.5 * w
        dv, db = earlier.T @ error + 0.5 * v, error.sum()
        gw, gv, gb = gw + dw ** 2, gv + dv ** 2, gb + db ** 2
        w, v, bias = w - 0.3 * dw / np.sqrt(gw), v - 0.3 * dv / np.sqrt(gv), bias - 0.3 * db / np.sqrt(gb)
    return w, v, bias


def fit(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES, per_class: Mapping[int, int] = PER_CLASS) -> dict[str, Link]:
    """The chain, fitted on a bounded sample outside the held-out share; its distinct words fit the driver.

    Earlier probabilities that a later model learns from are out of fold: documents are dealt to FOLDS parts by a
    hash of the id, and each part is predicted by a model of the others. Without labelled documents no category is ever predicted.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", dict(per_class))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, bucket, _ = word_counts(pdf["text"], BUCKETS)
            at = np.searchsorted(doc, np.arange(len(pdf) + 1))
            found = [set(re.findall(r"[^\W\d_]+", t.lower())) if isinstance(t, str) else set() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "bucket": [bucket[a:b] for a, b in zip(at, at[1:])],
                                "marks": [[int(bool(y) and (not w or not f.isdisjoint(w))) for w in categories.values()] for y, f in zip(pdf["label"], found)]})

    rows = sample.select("doc_id", "label", "text").mapInPandas(run, "doc_id long, bucket array<int>, marks array<int>").toPandas().sort_values("doc_id", kind="stable")
    none = np.zeros(0)
    if len(rows) == 0:
        return {name: Link(none.astype(np.int64), none, np.zeros(k), -60.0) for k, name in enumerate(categories)}
    counts = {r["label"]: r["count"] for r in clean_labels(labels, "toxic").groupBy("label").count().collect()}
    marks = np.array(rows["marks"].tolist(), float)
    row = np.repeat(np.arange(len(rows)), rows["bucket"].map(len))
    buckets, column = np.unique(np.concatenate(rows["bucket"].tolist()).astype(np.int64), return_inverse=True)
    fold = pd.util.hash_array(rows["doc_id"].to_numpy(np.int64)) % FOLDS
    toxic = np.array(rows["marks"].map(lambda m: m[-1]), float)
    shift = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)) - np.log((toxic.sum() + 0.5) / (len(rows) - toxic.sum() + 0.5)))
    chain, earlier = {}, np.zeros((len(rows), 0))
    for k, name in enumerate(categories):
        y, out = marks[:, k], np.zeros(len(rows))
        for part in range(FOLDS):
            held = fold == part
            inside = ~held[row]
            number = np.cumsum(~held) - 1
            w, v, b = _train(number[row[inside]], column[inside], earlier[~held], y[~held], len(buckets))
            out[held] = sigmoid(b + np.bincount(row, weights=w[column], minlength=len(rows))[held] + earlier[held] @ v)
        w, v, b = _train(row, column, earlier, y, len(buckets))
        kept = np.abs(w) > 1e-4
        chain[name] = Link(buckets[kept], w[kept].astype(np.float32), v, b, shift)
        earlier = np.column_stack([earlier, out])
    return chain


def predict(texts: pd.Series, chain: Mapping[str, Link]) -> pd.DataFrame:
    """One probability per category, each computed with those before it."""
    doc, bucket, _ = word_counts(texts, BUCKETS)
    earlier, shown = np.zeros((len(texts), 0)), {}
    for name, link in chain.items():
        table = np.zeros(BUCKETS, np.float32)
        table[link.buckets] = link.weights
        z = link.bias + np.bincount(doc, weights=table[bucket], minlength=len(texts)) + earlier @ link.earlier
        earlier = np.column_stack([earlier, sigmoid(z)])
        shown[name] = sigmoid(z + link.shift)
    return pd.DataFrame(shown)


def score(docs: DataFrame, chain: Mapping[str, Link], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, a probability per category, score (the last one) and predicted for every row of ``docs``.

    Null and empty texts have no word, so their score is the base rate's. Repeated rows give repeated results; only
    the text is an input. The models are broadcast; each holds at most the buckets of the bounded sample.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(dict(chain))

    @F.pandas_udf(", ".join(f"{name} double" for name in chain))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict(texts.reset_index(drop=True), shared.value)

    last = list(chain)[-1]
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), run("text").alias("_p"))
    return own.select("doc_id", "held_out", *[F.col(f"_p.{name}").alias(f"p_{name}") for name in chain], F.col(f"_p.{last}").alias("score"),
                      (F.col(f"_p.{last}") >= threshold).cast("int").alias("predicted"))
