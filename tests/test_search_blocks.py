"""Search of blocks of documents against all queries at once, against the plan that makes a row of every pair."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litquarry.operators import retrieval as rt

QID = ["experiment_id", "query_no"]
BOOSTS = {"title": 3.0, "text": 1.0}


def _rows(hits):
    return sorted(tuple(r) for r in hits.select("query_no", "rank", "doc_id", "score", "experiment_id").collect())


@pytest.mark.parametrize("k", [1, 6, 80])
def test_search_equals_rows_of_pairs(spark, monkeypatch, k):
    rng = random.Random(k)
    line = lambda n: " ".join(f"w{min(int(rng.expovariate(0.2)), 60)}" for _ in range(n))
    rows = [(f"{i}:{i % 3}", line(3), line(rng.choice((1, 9, 40)))) for i in range(400)]
    rows += [(f"t{i:02}", "w3 w4", "w4 w61") for i in range(40)] + rows[:30] + [("n", None, None), (None, "w1", "w2 w61")]  # ties, keys that come twice
    docs = spark.createDataFrame(rows, "id string, title string, text string")
    texts = ["w61", "w3 w4 w4", "w1 w2 w3 w61", "unheard w1", "unheard", "", None, "w0"] + [line(8) for _ in range(30)]
    queries = spark.createDataFrame([(None if i == 3 else i % 5, i, t) for i, t in enumerate(texts)], "experiment_id long, query_no int, query string")
    index = rt.build_index(docs, "id", {f: F.col(f) for f in BOOSTS})
    found = rt.bm25(index, queries, QID, k, BOOSTS), rt.text_match(index, queries, QID, k)
    for hits in found:
        assert "MapInArrow" in hits._jdf.queryExecution().toString()  # pairs of query and document never become rows
    monkeypatch.setattr(rt, "QUERY_BROADCAST_ROWS", 0)
    plain = rt.bm25(index, queries, QID, k, BOOSTS), rt.text_match(index, queries, QID, k)
    for a, b in zip(found, plain):
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
        assert a.columns == b.columns and a.schema.simpleString() == b.schema.simpleString()


def test_documents_are_never_cut_in_two(monkeypatch):
    monkeypatch.setattr(rt, "READ_ROWS", 5)
    ids = [None, None] + ["a"] * 7 + ["b"] + ["c"] * 3 + ["d"] * 12
    whole = pa.table({"doc_id": pa.array(ids, pa.string()), "no": pa.array(range(len(ids)), pa.int32()), "x": pa.array(np.arange(len(ids)) / 2)})
    found = []
    for docs, first, term, x in rt._whole_documents(iter(whole.to_batches(max_chunksize=3))):
        for i, doc in enumerate(docs.to_pylist()):
            found.append((doc, term[first[i]:first[i + 1]].tolist()))
            assert x[first[i]:first[i + 1]].tolist() == [t / 2 for t in found[-1][1]]
    assert [d for d, _ in found] == [None, "a", "b", "c", "d"]
    assert [t for _, held in found for t in held] == list(range(len(ids)))


@pytest.mark.parametrize("gain, cells", [(0, 7), (0, 1 << 20), (10**9, 7)])
def test_products_by_either_way(monkeypatch, gain, cells):
    monkeypatch.setattr(rt, "DENSE_GAIN", gain)
    monkeypatch.setattr(rt, "SCORE_CELLS", cells)
    rng = np.random.default_rng(4)
    row, term, x = rng.integers(0, 9, 200), rng.integers(0, 30, 200), rng.random(200)
    held = np.sort(rng.choice(30 * 5, 60, replace=False))
    t, q, n = held // 5, held % 5, rng.integers(1, 4, 60).astype(float)
    starts = np.searchsorted(t, np.arange(31))
    wide, docs = np.zeros((30, 5)), np.zeros((9, 30))
    wide[t, q] = n
    np.add.at(docs, (row, term), x)
    block = (row, term, 9, 5, starts, q, n)
    assert np.allclose(rt._products(x, *block), docs @ wide)
    assert (rt._products(None, *block) == (docs > 0).astype(float) @ (wide > 0)).all()
