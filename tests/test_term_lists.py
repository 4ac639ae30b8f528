"""Searches over a kept index, which holds a row for each document, field and length, against the plain plan over postings."""

import random

import pytest
from pyspark.sql import functions as F

from litquarry.operators import retrieval as rt

QID = ["experiment_id", "query_no"]
BOOSTS = {"title": 3.0, "text": 1.0}


def _docs(spark, seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{min(int(rng.expovariate(0.2)), 60)}" for _ in range(n))
    rows = [(f"{i}:{i % 3}", line(3), line(rng.choice((1, 9, 40)))) for i in range(300)]
    rows += [(f"t{i:02}", "w3 w4", "w4 w61") for i in range(40)] + rows[:30]  # ties, documents that come twice
    rows += [("hot", "w5", line(4)) for _ in range(50)] + [(None, "w1", "W2 w61 w61")] * 12 + [("n", None, None), ("e", "", " - ")]
    return spark.createDataFrame(rows, "id string, title string, text string"), line


@pytest.mark.parametrize("batch, k", [(3, 6), (10_000, 80)])
def test_kept_index_finds_what_postings_find(spark, monkeypatch, batch, k):
    docs, line = _docs(spark, k)
    texts = ["w61", "w3 w4 w4", "w1 w2 w3 w61", "unheard w1", "unheard", "", None, "w0"] + [line(8) for _ in range(30)]
    queries = spark.createDataFrame([(None if i == 3 else i % 5, i, t) for i, t in enumerate(texts)], "experiment_id long, query_no int, query string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        index = rt.build_index(docs, "id", {f: F.col(f) for f in BOOSTS})
        kept = rt.materialised(index)
        assert kept.lists.groupBy("doc_id", "field", "dl").count().where("count > 1").isEmpty()
        rows = lambda df: sorted(map(str, df.select(*rt.POSTING).collect()))
        assert rows(kept.postings) == rows(index.postings)
        assert [(f.name, f.dataType) for f in kept.postings.schema] == [(f.name, f.dataType) for f in index.postings.select(*rt.POSTING).schema]
        for boosts in ({"text": 1.0},) if k == 6 else (BOOSTS,):
            hits = rt.bm25(kept, queries, QID, k, boosts)
            plan = hits._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan  # neither postings nor weights are joined
            with monkeypatch.context() as m:
                m.setattr(rt, "QUERY_BROADCAST_ROWS", 0)
                plain = rt.bm25(index, queries, QID, k, boosts)
            assert sorted(map(str, hits.collect())) == sorted(map(str, plain.collect()))
        hits = rt.text_match(kept, queries, QID, k)
        with monkeypatch.context() as m:
            m.setattr(rt, "QUERY_BROADCAST_ROWS", 0)
            plain = rt.text_match(index, queries, QID, k)
        assert sorted(map(str, hits.collect())) == sorted(map(str, plain.collect()))
        assert hits.schema.simpleString() == plain.schema.simpleString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_kept_index_of_no_document(spark):
    docs, _ = _docs(spark, 1)
    kept = rt.materialised(rt.build_index(docs.limit(0), "id", {"text": F.col("text")}))
    queries = spark.createDataFrame([(1, 1, "w1 w2")], "experiment_id long, query_no int, query string")
    assert rt.bm25(kept, queries, QID, 5, {"text": 1.0}).isEmpty() and rt.text_match(kept, queries, QID, 5).isEmpty()
