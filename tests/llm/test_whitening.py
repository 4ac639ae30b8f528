"""Whitening against exact fractions and numpy's covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from litquarry.llm import queries, whitening  # noqa: F401
from litquarry.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component int, `x` string"


def plain(vectors):
    """(x, exact covariance as fractions) of lists of doubles."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    cov = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n ** 3) for j in range(d)] for i in range(d)]
    return x, sums, cov


def test_query_against_fractions(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x, sums, cov = plain([[float(np.float32(c)) for c in r.embedding] for r in rows])
    n = len(rows)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {r.vec_id: [sum((n * a - s) ** 2 for a, s in zip(row, sums)), np.array([a - s / n for a, s in zip(row, sums)]) @ vectors / np.sqrt(values)] for r, row in zip(rows, x)}
    got = QUERIES["op11_embedding_whitening"](spark, FOLDER).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        assert r.deviation == want[r.vec_id][0]
        other = want[r.vec_id][1][r.component - 1]
        if abs(other) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened) == np.sign(other))
        assert abs(abs(r.whitened) - abs(other)) < 1e-6
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert all(len(s) == 1 for s in signs.values())
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 < errors.pop() < 1e-9


def test_odd_vectors(spark):
    bad = [(1, None, 1, "a"), (2, [1.0, None], 1, "a"), (3, [1.0, float("nan")], 1, "a"), (4, [float("inf"), 0.0], 1, "a"), (5, [], 1, "a"), (6, [1.0], 1, None)]
    good = [(7, [0.5, -0.25], None, None), (None, [0.1, 0.3], 1, "a"), (8, [-1.0, 2.0], 1, "a"), (8, [-1.0, 2.0], 1, "a"), (9, [0.1, 0.1], 1, "a")]
    rows = whitening.whole_vectors(spark.createDataFrame(bad + good, SCHEMA))
    model = whitening.fit(rows)
    got = whitening.whiten(rows, model).orderBy("vec_id", "component").collect()
    assert model.n == 5 and [(r.vec_id, r.component) for r in got] == [(i, k) for i in (None, 7) for k in (1, 2)] + [(8, 1), (8, 1), (8, 2), (8, 2), (9, 1), (9, 2)]
    x, sums, cov = plain([[float(np.float32(c)) for c in r[1]] for r in good])
    assert model.sums == sums
    assert sorted(model.values) == pytest.approx(sorted(np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov]))))
    assert all(r.identity_error < 1e-12 for r in got)


def test_empty_single_and_equal_rows(spark):
    empty = whitening.whole_vectors(spark.createDataFrame([], SCHEMA))
    assert whitening.whiten(empty, whitening.fit(empty)).collect() == []
    for rows in ([(1, [0.5, 1.5], 1, "a")], [(i, [0.5, 1.5], 1, "a") for i in range(3)]):
        own = whitening.whole_vectors(spark.createDataFrame(rows, SCHEMA))
        got = whitening.whiten(own, whitening.fit(own)).collect()
        assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in got] == [(0.0, 0, 0.0, 0.0)] * (2 * len(rows))


def test_entries_too_wide_for_64_bits(spark):
    """Squares of such entries go through whole numbers of any size and stay exact."""
    rng = np.random.default_rng(3)
    vectors = [[float(a), float(b)] for a, b in rng.integers(-(1 << 45), 1 << 45, (40, 2))]
    rows = whitening.whole_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3))
    model = whitening.fit(rows)
    _, sums, cov = plain(vectors)
    assert model.sums == sums
    assert sorted(model.values) == pytest.approx(sorted(np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov]))), rel=1e-12)
    far = whitening.whiten(rows, model).where(F.col("deviation") == (1 << 63) - 1)
    assert far.count() > 0


def test_few_rows_leave_components_without_spread(spark):
    rows = whitening.whole_vectors(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(4)], "vec_id long, embedding array<double>"))
    model = whitening.fit(rows)
    got = whitening.whiten(rows, model).collect()
    assert model.usable.tolist() == [True, False, False]
    assert all(r.whitened == 0 for r in got if r.component > 1) and got[0].identity_error < 1e-12
