"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from litquarry.llm.common import bounded_batches, hashed_share, held_out

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
REACH = max(ORDERS) - 1  # characters in front of the last one of an n-gram
PER_LANGUAGE = 1500  # documents of each language to fit on, about
UNKNOWN = "und"
_BLOCK = 1 << 19  # characters worked on at once
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, float32


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, code points, bounds) of bounded size; a longer text comes in several blocks.

    In front of every piece stand the REACH characters before it, line feeds at a text's start; bounds are the
    places where a piece itself begins and ends, in turn. So an n-gram is counted once, at its last
    character, and never holds a character of another text.
    """
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), _BLOCK):
            part = (text[at - REACH:at] if at else "\n" * REACH) + text[at:at + _BLOCK]
            if parts and size + len(part) > _BLOCK:
                yield _points(numbers, parts)
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield _points(numbers, parts)


def _points(numbers: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    buffer = np.frombuffer("".join([*parts, "\n"]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.array(numbers), buffer, np.stack([np.append(0, ends[:-1]) + REACH, ends], axis=1).reshape(-1)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each piece; a piece may be empty."""
    return np.where(bounds[::2] < bounds[1::2], np.add.reduceat(values, bounds, dtype=np.float64)[::2], 0.0)


def ngram_buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram ending at every place (the first ones of the buffer are short)."""
    rolled = np.zeros(len(points), np.uint32)
    for order in ORDERS:
        mixed = points * _MULTIPLIERS[order - 1]
        mixed ^= mixed >> np.uint32(15)
        if order == 1:
            rolled = mixed.copy()
        else:
            shifted = np.empty_like(mixed)
            shifted[:order - 1] = 0
            shifted[order - 1:] = mixed[:len(mixed) - order + 1]
            rolled = (rolled ^ shifted) * np.uint32(0x01000193)
        yield ((rolled ^ (rolled >> np.uint32(16))) & np.uint32(BUCKETS - 1)).astype(np.int32)


def normal(text: str | None) -> str:
    return "" if text is None or text is pd.NA or text != text else text.lower()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, smoothing: float = 0.1) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows outside the held-out share, about ``per_language`` documents of each language.

    Rows with a null text, lang or id are not learned from. No labelled row gives a model of no language.
    """
    known = docs.select("doc_id", "text", F.col("lang").alias("_lang")).where(F.col("_lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy("_lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    sample = known.where(hashed_share(F.col("doc_id"), F.element_at(share, F.col("_lang"))) & F.col("text").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {}
        for pdf in batches:
            for lang, text in zip(pdf["_lang"], pdf["text"]):
                own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, points, (first, end) in _blocks([normal(text)]):
                    for buckets in ngram_buckets(points):
                        own += np.bincount(buckets[first:end], minlength=BUCKETS)
        for lang, own in totals.items():
            yield pd.DataFrame({"_lang": [lang], "n": [own]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_lang": [pdf["_lang"].iloc[0]], "n": [np.sum(np.stack(list(pdf["n"])), axis=0)]})

    # the sample is bounded, so the partial counts of eight tasks are, too
    partial = sample.select("_lang", "text").repartition(8).mapInPandas(count, "_lang string, n array<bigint>")
    summed = {r[0]: np.array(r[1], float) for r in partial.groupBy("_lang").applyInPandas(add, "_lang string, n array<bigint>").collect()}
    n = np.stack([summed.get(k, np.zeros(BUCKETS)) for k in languages], axis=1) + smoothing
    return LanguageModel(languages, np.log(n / n.sum(axis=0)).astype(np.float32))


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text: sparse rows of bucket numbers times the log-probability matrix."""
    lowered = [normal(t) for t in texts]
    total = np.zeros((len(lowered), len(model.languages)))
    columns = [np.ascontiguousarray(model.log_prob[:, j]) for j in range(total.shape[1])]
    for numbers, points, bounds in _blocks(lowered):
        for buckets in ngram_buckets(points):
            for j in range(total.shape[1]):
                np.add.at(total[:, j], numbers, _sums(np.take(columns[j], buckets), bounds))
    if not model.languages:
        return [UNKNOWN] * len(lowered), np.zeros(len(lowered))
    total -= total.max(axis=1, keepdims=True)
    chance = np.exp(total)
    chance /= chance.sum(axis=1, keepdims=True)
    best = chance.argmax(axis=1)
    has_letter = np.array([any(map(str.isalpha, t)) for t in lowered], bool)
    return ([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)],
            np.where(has_letter, chance[np.arange(len(best)), best], 0.0))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    A null text or one without a letter is ``und`` with score 0; repeated rows give repeated results; ties go to
    the language that sorts first; other columns are not looked at. The matrix travels as one broadcast variable
    of 256 KB a language.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_column(docs.sparkSession, model, F.col("text")).alias("_p")).select(
        "doc_id", "held_out", "_p.lang_pred", "_p.score")


def language_column(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """Struct (lang_pred, score) for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score = predict(list(s), shared.value)
            yield pd.DataFrame({"lang_pred": lang, "score": score})
    return run(text)
