"""Every route of the experiment is searched once, however many families read its hits; a vector of hashed words hashes each word once."""

from collections import Counter

from pyspark.sql import functions as F

from litquarry.operators import retrieval as rt
from litquarry.plans import experiment


def test_hashed_embedding_counts_words(spark):
    rows = spark.createDataFrame([("Root rot, root",), ("",), (None,)], "text string").select(
        rt.hashed_embedding("text", 8).alias("v"), F.transform(rt.tokens("text"), lambda t: F.md5(t)).alias("m")).collect()
    for r in rows[:2]:
        n = Counter(int(m[:4], 16) % 8 for m in r.m)
        assert r.v == [float(n[i]) for i in range(8)]
    assert rows[2].v == rows_of_null(spark)


def rows_of_null(spark):
    """What the vector of an unknown text was: the size of an unknown list in every place."""
    return spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.size(F.lit(None).cast("array<int>")).cast("double")).alias("v")).first().v


def test_a_route_is_searched_once(spark, monkeypatch):
    read, held = [], []
    monkeypatch.setattr(experiment, "cut", lambda df: held.append(df.columns) or df.checkpoint())
    monkeypatch.setattr(rt, "knn", lambda v, q, k, *a: read.append(1) or real(v, q, k, *a))
    chunks = spark.createDataFrame([(d, i, f"{d}:{i}", "Results", f"root rot number {d} of cells") for d in range(5) for i in range(2)],
                                   "document_id long, chunk_index int, chunk_id string, section_path string, text string")
    q = spark.createDataFrame([(1, 0, "root rot"), (2, 0, "number of cells")], "experiment_id long, query_no int, query string")
    labels = spark.createDataFrame([(d, "RELEVANT" if d % 2 else "IRRELEVANT") for d in range(5)], "document_id long, label string")
    found = experiment.run_experiment(chunks, {"A": q, "B": q}, labels)
    assert len(read) == 1 and sum("score" in c and "route" not in c for c in held) == 3
    assert {r.route for r in found.select("route").distinct().collect()} >= {"A_BM25", "B_DENSE", "A_OVERALL"}


real = rt.knn


def test_a_task_keeps_its_best_over_all_batches(spark):
    """Rows that leave a task are k for each query, not k of every batch it reads."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, [float(i % 9 - 4), float(i % 4 - 1)]) for i in range(100)]
        v = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
        q = spark.createDataFrame([(3, [1.0, 0.0]), (50, [0.5, 2.0])], "query_id long, vector array<double>")
        for least, own in ((0.0, False), (0.6, True)):
            found = sorted((r.query_id, r["rank"], r.id, r.score) for r in real(v, q, 5, least, own).collect())
            cos = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / (((a[0]**2 + a[1]**2) * (b[0]**2 + b[1]**2))**0.5 or 1.0)
            want = []
            for qid, qv in ((3, [1.0, 0.0]), (50, [0.5, 2.0])):
                s = sorted((-(int(((cos(x, qv) + 1) / 2) * 1e6 + 0.5) / 1e6), i) for i, x in rows if not own or i != qid)
                want += [(qid, n + 1, i, -x) for n, (x, i) in enumerate([y for y in s if -y[0] >= least][:5])]
            assert found == want
        given, mapped = [], type(v).mapInArrow
        try:
            type(v).mapInArrow = lambda df, f, schema, *a: given.append(f) or mapped(df, f, schema, *a)
            real(v, q, 5)
        finally:
            type(v).mapInArrow = mapped
        batches = v.toArrow().to_batches(max_chunksize=7)
        assert sum(b.num_rows for b in given[0](iter(batches))) == 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
