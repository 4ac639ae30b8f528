"""Language model and toxicity chain against plain loops; samples and neighbours in a batch."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from litquarry.llm import language_id, toxicity
from litquarry.llm.common import clean_labels, labelled_sample
from litquarry.llm.features import word_counts

MASK = (1 << 32) - 1


def plain_buckets(text):
    """Buckets of all n-grams of a lower-cased text, one character after the other."""
    points, out = [10] * language_id.REACH + [ord(c) for c in text], []
    for i in range(language_id.REACH, len(points)):
        rolled = 0
        for order in language_id.ORDERS:
            mixed = points[i - order + 1] * int(language_id._MULTIPLIERS[order - 1]) & MASK
            mixed ^= mixed >> 15
            rolled = mixed if order == 1 else (rolled ^ mixed) * 0x01000193 & MASK
            out.append((rolled ^ rolled >> 16) & (language_id.BUCKETS - 1))
    return out


TEXTS = ["The cat sat.", "der Hund läuft", "Étienne", "", "x", "the the the", "\n\nzwei\nZeilen ", "le chat " * 30, None]


def test_language_model_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(language_id, "_BLOCK", 37)
    docs = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    import zlib
    seen = {lang: Counter() for lang in "abc"}
    for i, t in enumerate(TEXTS * 4):
        if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None:
            seen["abc"[i % 3]].update(plain_buckets(t.lower()))
    for j, lang in enumerate(model.languages):
        total = sum(seen[lang].values()) + 0.1 * language_id.BUCKETS
        want = np.array([math.log((seen[lang][b] + 0.1) / total) for b in range(language_id.BUCKETS)])
        assert np.abs(model.log_prob[:, j] - want).max() < 1e-5
    names, scores = language_id.predict(TEXTS, model)
    for t, name, score in zip(TEXTS, names, scores):
        z = [sum(float(model.log_prob[b, j]) for b in plain_buckets((t or "").lower())) for j in range(3)]
        chance = [math.exp(x - max(z)) for x in z]
        want = max(chance) / sum(chance)
        letters = any(c.isalpha() for c in t or "")
        assert score == pytest.approx(want if letters else 0.0, abs=1e-9) and (name == model.languages[int(np.argmax(z))] if letters else name == "und")


def test_a_prediction_does_not_depend_on_its_neighbours(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgäéß") for _ in range(rng.randint(1, 6)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(9)), "xyz"[i % 3]) for i in range(120)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    texts = [word() for _ in range(300)]
    names, scores = language_id.predict(texts, model)
    for k in range(0, 300, 7):
        alone = language_id.predict([texts[k]], model)
        assert alone[0][0] == names[k] and alone[1][0] == scores[k]
    assert language_id.predict(["²", "½", "Ⅷ", "①", "12 345"], model)[0] == ["und"] * 5


def test_chain_reads_unshifted_probabilities():
    texts = pd.Series(["stupid words here", "nothing", None, "stupid useless", ""])
    _, bucket, _ = word_counts(pd.Series(["stupid useless"]), toxicity.BUCKETS)
    chain = {"a": toxicity.Link(bucket[:1].astype(np.int64), np.array([2.0]), np.zeros(0), -1.0, -1.4),
             "b": toxicity.Link(bucket.astype(np.int64), np.array([1.0, 0.5]), np.array([3.0]), -2.0, -1.4)}
    got = toxicity.predict(texts, chain)
    sig = lambda z: 1 / (1 + math.exp(-z))
    for i, t in enumerate(texts):
        own = set(word_counts(pd.Series([t]), toxicity.BUCKETS)[1].tolist())
        first = -1.0 + 2.0 * (bucket[0] in own)
        second = -2.0 + (bucket[0] in own) + 0.5 * (bucket[1] in own) + 3.0 * sig(first)
        assert got["a"][i] == pytest.approx(sig(first - 1.4)) and got["b"][i] == pytest.approx(sig(second - 1.4))


def test_a_cut_sample_keeps_recall(spark):
    """With fewer toxic documents in the sample than in the table scores are shifted, not the links' inputs."""
    rng = random.Random(9)
    plain = [f"w{rng.randrange(300)}" for _ in range(4000)]
    rows = [(i, " ".join(rng.sample(plain, 12)) + (" awful nasty" if i % 9 == 0 else ""), int(i % 9 == 0)) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.fit(docs, docs.select("doc_id", "toxic"), {"insult": ("awful",), "toxic": ()}, {1: 60, 0: 120})
    assert chain["toxic"].shift < -0.5
    got = toxicity.score(docs, chain).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got)


def test_sample_is_bounded_by_rows(spark):
    """One labelled id on most rows gives one row of the sample."""
    docs = spark.createDataFrame([(1, f"text {i}", None) for i in range(3000)] + [(i, "t", "x") for i in range(2, 40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", {0: 1000, 1: 1000}).collect()
    known = {r.doc_id for r in clean_labels(labels, "quality").collect()}
    assert sorted(r.doc_id for r in got) == sorted(known) and set(got[0].asDict()) == {"doc_id", "text", "lang", "label"}
