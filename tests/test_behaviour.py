"""Files, markup, streams, edge inputs and plan shapes."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from litquarry.functions import cells as ce, core, identifiers as ids
from litquarry.operators import corpus as cp, documents as do, fusion, ir_metrics as ir, retrieval as rt
from litquarry.sources import scans as sc
from litquarry.streaming import ingest as si
from litquarry.streaming.segments import Segments


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_scalar_cases(spark):
    r = one(spark, doi=ids.doi_normalise(F.lit("https://doi.org/10.1000/ABC.,")), none=ids.doi_normalise(F.lit("  ")), file=ids.doi_from_filename(F.lit("10.1234_abc.PDF")),
            tok=core.token_estimate(F.lit("abcdé")), blank=core.token_estimate(F.lit(" ")), uuid=ids.name_uuid(F.lit("k")),
            sim=ce.cell_similarity(F.lit("MIC 10"), F.lit("11"), F.lit("numeric")), cjk=ce.cell_similarity(F.lit("疫霉 a"), F.lit("疫霉 b"), F.lit("text")),
            kw=ids.split_keywords(F.lit("Late blight; late-blight • 12345 · root rot. ; copyright 2020")), year=ids.year_in(F.lit("id 120199 in 3020, 1998")))
    assert (r.doi, r.none, r.file) == ("10.1000/abc", None, "10.1234/abc")
    assert (r.tok, r.blank, r.sim) == (2, 0, 0.6)
    assert r.uuid[14] == "3" and r.cjk == pytest.approx(1 / 3)
    assert r.kw == ["Late blight", "root rot"] and r.year == 1998


def test_quality_of_multi_line_chunks(spark):
    df = spark.createDataFrame([(1, "short\r\n" + "x" * 30 + "?\n\n"), (1, "  "), (2, None)], "document_id long, text string")
    got = {r.document_id: r for r in cp.text_quality(df).collect()}
    assert (got[1].chunk_count, got[1].total_chars, got[1].short_line_ratio) == (2, 40, 0.5)
    assert got[1].replacement_ratio == 0.025 and got[2].total_chars == 0


def test_ir_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, "R", 0, "q", i + 1, d, f"c{i}", 1.0) for i, d in enumerate([10, 10, 11, 12, 13, 14])],
                                 "experiment_id long, route string, query_no int, query string, rank int, document_id long, chunk_id string, score double")
    j = spark.createDataFrame([(1, 11, "RELEVANT"), (1, 13, "RELEVANT"), (1, 12, "DISTRACTOR"), (1, 99, "RELEVANT")], "experiment_id long, document_id long, label string")
    keys = spark.createDataFrame([(1, "c2"), (1, "zz")], "experiment_id long, chunk_id string")
    m = {r.cut: r for r in ir.ir_metrics(hits, j, keys).collect()}
    # five hits give documents 10, 11, 12, 13
    assert (m[5].recall, m[5].precision, m[5].precision_at_k, m[5].recall_at_k, m[5].mrr) == (0.6667, 0.5, 0.4, 0.2, 0.5)
    assert m[5].average_precision == 0.3333 and m[5].key_chunk_recall == 0.5
    assert m[0].retrieved == 5 and m[0].precision == 0.4 and m[0].recall_at_k == 0.6667


def test_rerank_falls_back_when_everything_is_filtered(spark):
    c = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "experiment_id long, document_id long, doc_rank int")
    s = spark.createDataFrame([(1, 11, 0.9), (2, 12, 0.1)], "experiment_id long, document_id long, rerank_score double")
    got = sorted((r.experiment_id, r.document_id, r.rank) for r in fusion.apply_rerank(c, s, 0.2, fallback=True).collect())
    assert got == [(1, 11, 1), (2, 12, 1)]


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "document_id long, text string")
    index = rt.build_index(docs, "document_id", {"text": F.col("text")})
    q = spark.createDataFrame([(1, 0, "a b")], "experiment_id long, query_no int, query string")
    assert rt.bm25(index, q, ["experiment_id", "query_no"], 5, {"text": 1.0}).count() == 0
    assert cp.dedup(spark.createDataFrame([], "document_id long, doi string, sha string")).count() == 0


def test_index_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 3} common") for i in range(20)], "document_id long, text string")
    index = rt.build_index(docs, "document_id", {"text": F.col("text")})
    rt.write_index(index, str(tmp_path / "ix"), 4)
    rows = lambda ix: sorted(tuple(r) for r in ix.postings.select("doc_id", "field", "dl", "term", "tf").collect())
    assert rows(rt.read_index(spark, str(tmp_path / "ix"))) == rows(index)


def test_stored_index_reads_only_shards_of_the_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 50} common") for i in range(200)], "document_id long, text string")
    built = rt.build_index(docs, "document_id", {"text": F.col("text")})
    rt.write_index(built, str(tmp_path / "ix"))
    index = rt.read_index(spark, str(tmp_path / "ix"))
    terms = spark.createDataFrame([("w7",)], "term string")
    found = index.of_terms(terms)
    assert sorted(r.doc_id for r in found.collect()) == [7, 57, 107, 157]
    assert "PartitionFilters: [isnotnull(term_shard_of_64" in found._jdf.queryExecution().executedPlan().toString()
    q = spark.createDataFrame([(1, 0, "w7 common")], "experiment_id long, query_no int, query string")
    best = lambda ix: [tuple(r) for r in rt.bm25(ix, q, ["experiment_id", "query_no"], 5, {"text": 1.0}).orderBy("rank").collect()]
    assert best(index) == best(built) == best(rt.materialised(built))
    none = rt.build_index(docs.limit(0), "document_id", {"text": F.col("text")})
    rt.write_index(none, str(tmp_path / "none"))
    empty = rt.read_index(spark, str(tmp_path / "none"), none.postings.select(*rt.POSTING).schema)
    assert rt.bm25(empty, q, ["experiment_id", "query_no"], 5, {"text": 1.0}).count() == 0


def test_markup_units(spark):
    html = ("<html><head><title>T one.</title><script>var x='<p>no</p>'</script></head><body><nav><p>menu</p></nav><h1>Methods</h1><p>A b. C d!</p><h2>Assay</h2><p>E &amp; f</p>"
            "<h1>References</h1><p>cited</p></body></html>")
    got = sc.extract_units(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.content_type, r.section_path, r.text) for r in got] == [
        ("title", "", "T one."), ("body", "Methods", "A b."), ("body", "Methods", "C d!"), ("body", "Methods > Assay", "E & f")]


def test_files_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("x")
    (tmp_path / "in" / "deep" / "b.txt").write_text("x")
    files = sc.scan_files(spark, str(tmp_path / "in")).collect()
    assert len(files) == 2 and len({f.sha256 for f in files}) == 1
    (tmp_path / "m.csv").write_text('﻿id,title\n1,"two\nlines ""quoted"""\n2,plain\n', encoding="utf-8")
    rows = sc.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("id").collect()
    assert rows[0].title == 'two\nlines "quoted"' and len(rows) == 2
    target = sc.write_run(spark.createDataFrame([(1, "a")], "id int, t string"), str(tmp_path / "out"), "r1", "csv")
    assert spark.read.option("header", True).csv(target).count() == 1
    sc.write_markdown(spark.createDataFrame([("a|b",)], "t string"), str(tmp_path / "md"), ["t"])
    assert spark.read.text(str(tmp_path / "md")).first().value == "| a\\|b |"


@pytest.mark.parametrize("block", [3, 4096])
def test_section_roles_carry_over_pages(spark, block):
    texts = [(1, "Background of the field"), (1, "prior work"), (2, "Detailed description of the work"), (2, "TEST A on Phytophthora"), (2, "plates were sprayed"), (3, "Results: inhibition of growth"), (3, "more text"),
             (4, "Claims"), (4, "1. use"), (7, "plain after a gap"), (7, "TEST B"), (7, "Results are shown, no target")]
    df = spark.createDataFrame([(1, p, i, t) for i, (p, t) in enumerate(texts)], "document_id long, page_number int, paragraph int, text string")
    got = [(r.role, r.assay_id, r.eligible) for r in do.section_roles(df, block).orderBy("pos").collect()]
    assert got == [("BACKGROUND", 0, False)] * 2 + [("OTHER", 0, False)] + [("METHOD", 1, True)] * 2 + [("RESULT", 1, True)] * 2 + [("CLAIMS", 0, False)] * 2 + [
        ("OTHER", 0, False), ("METHOD", 2, False), ("RESULT", 2, False)]


def _drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_folder_ingest_stream(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    _drop(src, "1.json", [{"document_id": 1, "doi": "d1", "text": "a"}, {"document_id": 2, "doi": "d1", "text": "b"}, {"document_id": 3, "text": "b"}, {"document_id": 4}])
    si.ingest_folder(spark, str(src), out, ck).awaitTermination()
    _drop(src, "2.json", [{"document_id": 5, "doi": "d1", "text": "z"}, {"document_id": 6, "text": "new"}])
    si.ingest_folder(spark, str(src), out, ck).awaitTermination()
    got = {r.document_id: (r.status, r.duplicate_of) for r in spark.read.parquet(out + "/outcomes").collect()}
    assert got == {1: ("COMPLETED", None), 2: ("DUPLICATE_SKIPPED", 1), 3: ("COMPLETED", None), 4: ("FAILED", None), 5: ("DUPLICATE_SKIPPED", 1), 6: ("COMPLETED", None)}
    assert {r.status: r.n for r in si.outcome_counters(spark, out).collect()} == {"COMPLETED": 3, "DUPLICATE_SKIPPED": 2, "FAILED": 1}


def test_folder_ingest_counts_repeated_rows_as_duplicates(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    _drop(src, "1.json", [{"document_id": 7, "text": "a"}] * 3 + [{"document_id": 8, "doi": "d", "text": "b"}] * 2 + [{"document_id": 7, "text": "other"}])
    si.ingest_folder(spark, str(src), out, str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.document_id, r.status, r.duplicate_of or 0) for r in spark.read.parquet(out + "/outcomes").collect())
    assert got == [(7, "COMPLETED", 0), (7, "COMPLETED", 0), (7, "DUPLICATE_SKIPPED", 7), (7, "DUPLICATE_SKIPPED", 7), (8, "COMPLETED", 0), (8, "DUPLICATE_SKIPPED", 8)]
    assert si.accepted_keys(spark, out).read().where("key LIKE 'sha256:%'").count() == 3


def test_index_stream(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    _drop(src, "1.json", [{"document_id": 1, "text": "red red"}, {"document_id": 2, "text": "blue"}])
    si.index_stream(spark, str(src), out, ck).awaitTermination()
    _drop(src, "2.json", [{"document_id": 1, "text": "green"}, {"document_id": 2, "deleted": True}, {"document_id": 3, "text": "blue"}])
    si.index_stream(spark, str(src), out, ck).awaitTermination()
    assert sorted((r.doc_id, r.term, r.tf) for r in si.current_index(spark, out).postings.collect()) == [(1, "green", 1), (3, "blue", 1)]


def test_index_stream_takes_the_last_row_of_a_batch(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    _drop(src, "1.json", [{"document_id": 1, "text": "zebra old"}, {"document_id": 1, "text": "apple new"}, {"document_id": 2, "text": "gone"}, {"document_id": 2, "deleted": True},
                          {"document_id": 2, "text": "back"}, {"document_id": 3, "text": "later", "sequence": 2}, {"document_id": 3, "text": "early", "sequence": 1}])
    si.index_stream(spark, str(src), out, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.doc_id, r.term) for r in si.current_index(spark, out).postings.collect()) == [(1, "apple"), (1, "new"), (2, "back"), (3, "later")]


def test_segments_stay_few_and_replays_change_nothing(spark, tmp_path):
    seg = Segments(spark, str(tmp_path / "s"), "k long, v long", fan=3)
    assert seg.read().count() == 0
    for b in range(14):
        seg.append(spark.createDataFrame([(b, b * b), (b, None)], seg.ddl), b)
        before = sorted(map(repr, seg.read().collect())), seg.manifest()
        seg.append(spark.createDataFrame([(b, b * b), (b, None)], seg.ddl), b)
        assert (sorted(map(repr, seg.read().collect())), seg.manifest()) == before
        assert len(seg.manifest()) <= 2 * 3
    assert seg.read().count() == 28 and sorted(t for _, t in seg.manifest()) == [0, 0, 1, 2]
    assert seg.read(before=5).count() == 10


def test_ingest_resumes_and_replays(spark, tmp_path, monkeypatch):
    """Many starts over merged segments; the last batch is run a second time, as after a loss of its commit."""
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    for i in range(6):
        _drop(src, f"{i}.json", [{"document_id": 10 * i + j, "doi": f"d{(i * j) % 4}" if j % 2 else None, "text": f"t{(i + j) % 5}"} for j in range(4)])
        si.ingest_folder(spark, str(src), out, ck).awaitTermination()
    rows = lambda: sorted(map(repr, spark.read.schema(si.OUTCOME).parquet(out + "/outcomes").collect()))
    keys = lambda: sorted(map(repr, si.accepted_keys(spark, out).read().collect()))
    first, held = rows(), keys()
    docs = spark.createDataFrame([(10 * i + j, f"d{(i * j) % 4}" if j % 2 else None, f"t{(i + j) % 5}") for i in range(6) for j in range(4)], "document_id long, doi string, text string")
    want = {r.document_id: r.duplicate_of for r in cp.dedup(docs.withColumn("sha", F.sha2("text", 256))).collect()}
    got = {r.document_id: r.duplicate_of for r in spark.read.schema(si.OUTCOME).parquet(out + "/outcomes").collect()}
    assert got == want and len(si.accepted_keys(spark, out).manifest()) <= 6
    (tmp_path / "ck" / "commits" / "5").unlink()
    (tmp_path / "ck" / "commits" / ".5.crc").unlink(missing_ok=True)
    si.ingest_folder(spark, str(src), out, ck).awaitTermination()
    assert rows() == first and keys() == held


def test_index_segments_drop_replaced_postings(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    for i in range(6):
        _drop(src, f"{i}.json", [{"document_id": 1, "text": f"w{i} w{i}"}, {"document_id": 10 + i, "text": "same"}, {"document_id": 9 + i, "deleted": True}])
        si.index_stream(spark, str(src), out, ck).awaitTermination()
    assert sorted((r.doc_id, r.term, r.tf) for r in si.current_index(spark, out).postings.collect()) == [(1, "w5", 2), (15, "same", 1)]
    postings, touched = si.posting_segments(spark, out)
    assert len(postings.manifest()) == 3 and postings.read().where("doc_id = 1").count() == 3


def test_zero_vectors_do_not_break_linkage(spark):
    from litquarry.operators import cluster
    assert spark.createDataFrame([(1,)], "a int").select(cluster._unit(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_usage_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from litquarry.plans.report_queries import step_events
    src = str(tmp_path / "src")
    step_events(rows).repartition(3).write.parquet(src)
    stream = si.usage_stream(spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src), watermark="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.sql("select * from usage")) == key(si.usage_stream(step_events(rows)))


NO_PYTHON = ["a3_facet_counts", "d5_screening_decision", "j1_evidence_with_document", "w1_priority_chunks", "a14_classification_merge", "f8_name_kind_and_key", "d9_versioned_replace"]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_plans_stay_in_the_engine(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = entry.queries()["w1_priority_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["p6_membership_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
