"""Pairs of equal vectors, of repeated ids and around unknown vectors; components of many edges."""

import numpy as np
import pytest

from litquarry.operators import cluster as cl


def _rows(m):
    return [(i, v) for i, v in enumerate(m.tolist())]


def test_copies_take_part_in_all_their_pairs(spark, tmp_path):
    from litquarry.plans import load_all
    from litquarry.plans.registry import QUERIES

    load_all()
    m = np.random.default_rng(1).normal(size=(12, 8))
    m = np.concatenate([m, m[:5], m[:2]])
    df = spark.createDataFrame([*_rows(m), (3, m[3].tolist()), (90, None), (None, m[0].tolist())], "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = [*range(len(m)), 3]
    want = sorted((ids[i], ids[j]) for i in range(len(ids)) for j in range(len(ids)) if ids[i] < ids[j] and 1 - u[ids[i]] @ u[ids[j]] < 0.75)
    found = QUERIES["c1_cosine_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b) for r in found) == want
    assert {(0, 12), (0, 17), (12, 17), (4, 16)} <= {(r.a, r.b) for r in found if r.distance == 0.0}


@pytest.mark.parametrize("limit", [0.05, 0.5])
def test_copies_in_cells(spark, limit):
    rng = np.random.default_rng(2)
    m = np.repeat(np.eye(10), 30, axis=0) + rng.normal(size=(300, 10)) * 0.001
    m[100:140] = m[7]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(1 - u @ u.T < limit)) if i < j}
    found = cl.cosine_pairs(spark.createDataFrame(_rows(m), "id long, vector array<double>"), limit, block_rows=32).collect()
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want


@pytest.mark.parametrize("at_once", [4, 64, 1 << 20])
def test_components_by_few_links(spark, monkeypatch, at_once):
    monkeypatch.setattr(cl, "LINKS_AT_ONCE", at_once)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(300, 300), (7, 7), (200, 201)]
    rng = np.random.default_rng(3)
    pairs = [pairs[i] for i in rng.permutation(len(pairs))]
    found = cl.connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    want = {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 141)}, 300: 300, 200: 200, 201: 200}
    assert len(found) == len(want) and {r.id: r.component for r in found} == want


def test_components_take_few_jobs(spark, monkeypatch):
    """Plans of rounds fill the driver's memory; few links are joined at once."""
    calls, stored = [], cl.stored
    monkeypatch.setattr(cl, "stored", lambda df: calls.append(1) or stored(df))
    monkeypatch.setattr(cl, "cut", lambda df: calls.append(1) or df.checkpoint())
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long").repartition(8)
    assert {r.component for r in cl.connected_components(chain).collect()} == {0}
    assert len(calls) <= 2
