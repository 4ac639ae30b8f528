"""Dictionary matching by automaton against plain substring and token tests."""

import random
import re

import pytest

from litquarry.operators import entity as en

TEXTS = [(1, "The late Blight, late-blight and rot."), (2, None), (3, ""), (4, "İstanbul ROT rot"), (5, "疫霉 疫霉病 x"), (6, "aaaa"), (None, "blight rot")]


@pytest.mark.parametrize("shard_bytes", [4 << 20, 40])
def test_terms_and_words(spark, shard_bytes):
    rng = random.Random(5)
    texts = TEXTS + [(100 + i, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 80)))) for i in range(60)]
    vocab = [("rot", "ROT", "x"), ("late blight", "LB", "y"), ("blight", "LB", "y"), ("疫霉", "P", "x"), ("aa", "A", "x"), ("aa", "B", "x"), ("a", "short", "x"), ("t", "T", "x"), ("ab", "AB", "z"), ("bab", "BAB", "z"), ("a b", "A B", "z")]
    df, v = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(vocab, "alias string, canonical string, category string")
    low = [(k, spark.createDataFrame([(t or "",)], "t string").selectExpr("lower(t)").first()[0]) for k, t in texts[:7]] + [(k, t.lower()) for k, t in texts[7:]]
    want = {(k, c, g, a) for k, t in low for a, c, g in vocab if len(a) >= 2 and a in t}
    assert {tuple(r) for r in en.find_terms(df, ["k"], "text", v, shard_bytes).collect()} == want
    words = lambda t: " " + " ".join(re.findall(r"\w+", t)) + " "
    want = {(k, c, g, a) for k, t in low for a, c, g in vocab if len(a.split(" ")) <= 2 and f" {a} " in words(t)}
    got = en.find_words(df, ["k"], "text", v, 2, shard_bytes)
    assert {tuple(r) for r in got.collect()} == want


def test_no_gram_is_exploded(spark):
    v = spark.createDataFrame([("rot", "ROT", "x")], "alias string, canonical string, category string")
    df = spark.createDataFrame(TEXTS, "k long, text string")
    for out in (en.find_terms(df, ["k"], "text", v), en.find_words(df, ["k"], "text", v, 3)):
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert en.find_terms(df, ["k"], "text", v.limit(0)).collect() == []
