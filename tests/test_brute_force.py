"""Distributed operators against plain loops on small random inputs."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from litquarry.functions import identifiers as ids
from litquarry.operators import chunking as ck, cluster as cl, corpus as cp, evidence as ev, report as rp, retrieval as rt, topics as tp
from litquarry.scale import exact_median, global_rank


def test_global_rank_and_median(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rnd.randint(0, 20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {(r.g, r.id): r.rank for r in global_rank(df, ["g"], [F.col("v").desc(), F.col("id").asc()]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in own] == list(range(1, len(own) + 1))
    med = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    assert med == {g: float(np.median([r[1] for r in rows if r[0] == g])) for g in med}


def test_greedy_canonical_matches_scan(spark):
    rnd = random.Random(2)
    for n_keys in (4, 15):
        rows = [(i, rnd.choice([None, f"d{rnd.randrange(n_keys)}"]), f"s{rnd.randrange(n_keys)}") for i in range(80)]
        kept, dois, shas = [], set(), set()
        for i, d, s in rows:
            if (d and d in dois) or s in shas:
                continue
            kept.append(i)
            shas.add(s)
            if d:
                dois.add(d)
        df = spark.createDataFrame(rows, "i long, d string, s string")
        assert sorted(r.i for r in cp.greedy_canonical(df, "i", ["d", "s"]).collect()) == kept


def test_dedup_keeps_row_that_shares_a_key_with_a_removed_row(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "y"), (4, " ", "x")], "document_id long, doi string, sha string")
    got = {r.document_id: (r.duplicate_of, r.reason) for r in cp.dedup(df).collect()}
    assert got == {1: (None, None), 2: (1, "DOI"), 3: (None, None), 4: (1, "CONTENT_SHA256")}


def test_cohort_hash_levels(spark):
    ids = [f"id{i}" for i in range(1, 26)]
    df = spark.createDataFrame([("c", i + 1, v) for i, v in enumerate(ids)] + [("one", 1, "z")], "cohort string, ordinal long, document_id string")
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    got = {r.cohort: r.input_hash for r in cp.cohort_hash(df, block=10).collect()}
    assert got == {"c": sha([sha(ids[:10]), sha(ids[10:20]), sha(ids[20:])]), "one": sha([sha(["z"])])}
    assert {r.cohort: r.input_hash for r in cp.cohort_hash(df).collect()}["c"] == sha([sha(ids)])
    deep = {r.cohort: r.input_hash for r in cp.cohort_hash(df, block=4).collect()}  # 7 blocks, 2, 1
    low = [sha(ids[i:i + 4]) for i in range(0, 25, 4)]
    assert deep == {"c": sha([sha(low[:4]), sha(low[4:])]), "one": sha([sha(["z"])])}


# ---- packing -------------------------------------------------------------------------------------

def estimate(text):
    wide = sum(c > "\x7f" for c in text)
    return max(1, math.ceil((len(text) - wide) / 4) + wide) if text.strip() else 0


def pack_plain(texts, head, target, maximum, overlap):
    size = lambda xs: estimate(head + " ".join(xs))
    chunks, buf = [], []
    for u in texts:
        if not buf or size(buf + [u]) <= target or (size(buf + [u]) <= maximum and size(buf) < target // 2):
            buf.append(u)
            continue
        chunks.append(buf)
        buf = buf[-overlap:] if overlap else []
        while buf and size(buf + [u]) > maximum:
            buf = buf[1:]
        buf = buf + [u]
    return chunks + ([buf] if buf else [])


@pytest.mark.parametrize("block", [8, 4096])
def test_chunker_matches_plain_packing(spark, block):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9)))
    rows, want = [], {}
    for doc in (1, 2):
        for sec in ("A", "B"):
            texts = [" ".join(word() for _ in range(rnd.randint(1, 8))) for _ in range(60)]
            rows += [(doc, i + (1000 if sec == "B" else 0), "body", sec, 0, i, t) for i, t in enumerate(texts)]
            want[doc, sec] = [" ".join(c) for c in pack_plain(texts, f"Section: {sec}\n", 24, 40, 1)]
    df = spark.createDataFrame(rows, "document_id long, ord long, content_type string, section_path string, paragraph int, sentence int, text string")
    got = ck.chunk(df, 24, 40, 1, block=block).orderBy("document_id", "chunk_index").collect()
    for key, texts in want.items():
        assert [r.text for r in got if (r.document_id, r.section_path) == key] == texts
    for doc in (1, 2):
        assert [r.chunk_index for r in got if r.document_id == doc] == list(range(1, sum(len(v) for k, v in want.items() if k[0] == doc) + 1))


def test_oversized_unit_is_split(spark):
    df = spark.createDataFrame([(1, 0, "body", "A", 0, 0, "word " * 50)], "document_id long, ord long, content_type string, section_path string, paragraph int, sentence int, text string")
    got = ck.chunk(df, 24, 40, 0).orderBy("chunk_index").collect()
    assert " ".join(r.text for r in got).split() == ["word"] * 50
    assert all(estimate("Section: A\n" + r.text) <= 40 for r in got)


@pytest.mark.parametrize("block", [5, 4096])
def test_windows_match_plain_loop(spark, block):
    rnd = random.Random(4)
    sizes = {d: [rnd.randint(1, 900) for _ in range(40)] for d in (1, 2)}
    rows = [(d, i, f"{d}:{i}", "x" * s) for d, ss in sizes.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "document_id long, chunk_index int, chunk_id string, text string")
    got = ck.analysis_windows(df, 4, 1500, 1, block=block).orderBy("document_id", "window_no").collect()
    for d, ss in sizes.items():
        want, start = [], 0
        while start < len(ss):
            end, total = start, 0
            while end < len(ss) and end - start < 4 and (end == start or total + ss[end] <= 1500):
                total, end = total + ss[end], end + 1
            want.append((start + 1, end))
            if end >= len(ss):
                break
            start = max(start + 1, end - 1)
        assert [(r.first_pos, r.last_pos) for r in got if r.document_id == d] == want


def test_long_keyword_line_is_cleaned_once_per_keyword(spark):
    words = [f"{'Leaf-' if i % 3 else 'leaf '}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}" for i in range(1500)]
    words = [words[0].upper(), "x", "123", "copyright text", *words]
    df = spark.createDataFrame([(" ; ".join(words),), (", ".join(words),), (None,), ("",), (" ;; ",)], "t string").coalesce(1)
    began = time.monotonic()
    got = [r[0] for r in df.select(ids.split_keywords(F.col("t"), 1000)).collect()]
    assert time.monotonic() - began < 30  # minutes where each keyword cleans all others again
    want, seen = [], set()
    for w in words:
        key = "".join(x for x in w.lower() if x.isalnum())
        if w not in ("x", "123", "copyright text") and key not in seen:
            seen.add(key)
            want.append(w)
    assert len(want) > 500 and got == [want[:1000]] * 2 + [[]] * 3


# ---- matching and selection ----------------------------------------------------------------------

def test_greedy_match_matches_sequential_scan(spark):
    rnd = random.Random(5)
    for _ in range(3):
        pairs = [(1, "q", f"g{g}", f"p{p}", 1, 1, round(rnd.choice([0.6, 0.7, 0.8, 0.9]), 2)) for g in range(6) for p in range(6) if rnd.random() < 0.5]
        seen_g, seen_p, want = set(), set(), set()
        for _, _, g, p, _, _, s in sorted(pairs, key=lambda r: (-r[6], r[2], r[3])):
            if g not in seen_g and p not in seen_p:
                want.add((g, p))
                seen_g.add(g)
                seen_p.add(p)
        df = spark.createDataFrame(pairs, "document_id long, question_id string, g string, p string, g_copies long, p_copies long, score double")
        assert {(r.g, r.p) for r in ev.greedy_match(df).collect()} == want
        assert {(r.g, r.p) for r in ev.greedy_match(df, whole=True).collect()} == want


def test_claim_counts_make_no_row_per_claim_and_evidence(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(f"[文献{rnd.choice(['1', '2', '02', '7'])}]" for _ in range(rnd.randint(0, 3))) for _ in range(60)]
    claims = spark.createDataFrame([(rnd.choice([None, *range(20)]), rnd.choice([None, 1, 2]), t) for t in texts] + [(3, 1, None)], "claim_id long, report_id int, text string")
    evidence = spark.createDataFrame([(rnd.choice([None, 1, 1, 2]), rnd.choice([None, 1, 2]), rnd.randint(1, 9), rnd.choice([None, 4, 5, 6])) for _ in range(40)],
                                     "report_id int, literature_no int, evidence_id long, document_id long")
    chunks = spark.createDataFrame([(d, f"{d}:{i % 3}") for d in (4, 5) for i in range(5)] + [(None, "x"), (4, None)], "document_id long, chunk_id string")
    want = ev.claim_provenance(claims, evidence, chunks).groupBy("claim_id", "literature_no").agg(
        F.countDistinct("evidence_id").alias("evidence_rows"), F.countDistinct("chunk_id").alias("chunks"))
    key = lambda df: sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())
    made, whole = [], ev.claim_provenance
    monkeypatch.setattr(ev, "claim_provenance", lambda *a: made.append(whole(*a)) or made[-1])
    got = ev.claim_provenance_counts(claims, evidence, chunks)
    assert got.columns == want.columns and key(got) == key(want)
    assert made[0].count() < whole(claims, evidence, chunks).count() / 2


def _extracted(spark, groups: dict, seed: int):
    rnd = random.Random(seed)
    words = ["late", "blight", "root", "rot", "copper", "oil"]
    row = lambda k: (*k, [" ".join(rnd.sample(words, 3)), f"mic {rnd.randint(1, 30)}"])
    make = lambda: spark.createDataFrame([row(k) for k, n in groups.items() for _ in range(n)], "document_id long, question_id string, cells array<string>")
    return make(), make(), ev.Profile("Q1", ("Compound", "Activity data"), (0, 1))


def test_small_groups_are_compared_without_blocking_keys(spark, monkeypatch):
    def keys(*_):
        raise AssertionError("a small group was blocked")

    gold, predicted, profile = _extracted(spark, {(1, "a"): 9, (1, "b"): 4, (None, "a"): 40, (2, None): 40}, 6)
    found = lambda: sorted((r.document_id, r.question_id, r.g, r.p, r.g_copies, r.p_copies, r.score) for r in ev.similar_rows(gold, predicted, profile, 0.55).collect())
    monkeypatch.setattr(ev, "WHOLE_GROUP", 0)
    want = found()
    monkeypatch.setattr(ev, "WHOLE_GROUP", 32)
    monkeypatch.setattr(ev, "_blocks", keys)
    assert want and found() == want


def test_rows_of_large_and_small_groups_score_alike(spark, monkeypatch):
    gold, predicted, profile = _extracted(spark, {(1, "a"): 30, (2, "a"): 5, (3, "b"): 8}, 7)
    counts = lambda: sorted(tuple(r) for r in ev.score_rows(gold, predicted, profile, 0.55).collect())
    got = counts()  # document 1 has more rows than one task compares whole
    monkeypatch.setattr(ev, "WHOLE_GROUP", 0)
    assert counts() == got
    monkeypatch.setattr(ev, "WHOLE_GROUP", 1000)
    assert counts() == got


def _evidence(rnd, n):
    return [(f"e{i:03d}", rnd.randrange(6), f"c{rnd.randrange(8)}", f"s{rnd.randrange(4)}", f"o{rnd.randrange(5)}", "assay", rnd.choice(["EC50 1", "no activity"]), rnd.choice(["APPROVED", "PENDING"]),
             rnd.choice([None, 0.5, 0.9]), rnd.choice([" ", "target"]), rnd.choice([None, "field"]), rnd.choice([None, "conflict-1"]), float(rnd.randrange(8)), "type", i + 1) for i in range(n)]


EV_DDL = ("evidence_id string, document_id long, compound_name string, source_category string, organism string, assay_method string, activity_data string, review_status string, "
          "model_confidence double, mechanism string, application string, conflict_group string, match_score double, structure_type string, rank long")


def test_representative_selection_matches_plain_greedy(spark, monkeypatch):
    rnd = random.Random(6)
    for n, limit, step in ((60, 6, 1000), (60, 30, 5), (25, 40, 3)):
        monkeypatch.setattr(rp, "STEP_ROWS", step)
        rows = _evidence(rnd, n)
        df = spark.createDataFrame(rows, EV_DDL)
        base = lambda r: (min(5, r[12]) + (8 if r[7] == "APPROVED" else 1) + (6 if r[11] else 0) + (5 if "no activity" in r[6] else 0) + (4 if r[9].strip() else 0) + (3 if r[10] else 0) + (r[8] or 0))
        used, count, picked = [set(), set(), set(), set()], {}, []
        while len(picked) < limit:
            best = None
            for r in rows:
                if r[0] in picked or count.get(r[2], 0) >= 3:
                    continue
                keys = (r[3], r[2], r[1], r[4])
                s = round(base(r) + sum(0 if k in u else b for k, u, b in zip(keys, used, (4, 8, 3, 3))), 9)
                if best is None or (-s, r[0]) < best[0]:
                    best = ((-s, r[0]), r, keys)
            if best is None:
                break
            picked.append(best[1][0])
            count[best[1][2]] = count.get(best[1][2], 0) + 1
            for k, u in zip(best[2], used):
                u.add(k)
        picked += [r[0] for r in rows if r[0] not in picked][:limit - len(picked)]
        got = [r.evidence_id for r in rp.representative_selection(df, limit).orderBy("position").collect()]
        assert got == picked[:min(limit, n)]


def test_diverse_selection_reads_behind_a_very_frequent_compound(spark):
    df = spark.range(100_001).select(F.col("id").cast("string").alias("evidence_id"), F.when(F.col("id") == 100_000, "rare").otherwise("common").alias("compound_name"),
                                     F.col("id").alias("document_id"), (200_000 - F.col("id")).alias("score"), F.lit(None).cast("timestamp").alias("updated_at"))
    assert [r.evidence_id for r in rp.diverse_selection(df).orderBy("position").collect()] == ["0", "1", "2", "100000"]


def test_diverse_selection_matches_plain_loop(spark):
    rnd = random.Random(7)
    rows = [(r[0], r[1], r[2], float(rnd.randrange(5)), None) for r in _evidence(rnd, 80)]
    df = spark.createDataFrame(rows, "evidence_id string, document_id long, compound_name string, score double, updated_at timestamp")
    count, docs, want = {}, {}, []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(want) >= 14:
            break
        n = count.get(r[2], 0)
        if n >= 2 or (n == 0 and (len(count) >= 6 or len(docs.setdefault(r[1], set())) >= 1)):
            continue
        if n == 0:
            docs[r[1]].add(r[2])
        count[r[2]] = n + 1
        want.append(r[0])
    assert [r.evidence_id for r in rp.diverse_selection(df, 14, 6, 2, 1).orderBy("position").collect()] == want


def test_literature_budget_shares_what_is_left(spark):
    docs = spark.createDataFrame([(1, 1, 100, 900), (2, 2, 50, 10)], "document_id long, position long, metadata_chars long, abstract_chars long")
    chunks = spark.createDataFrame([(1, 1, 5000), (1, 2, 100), (2, 1, 9000)], "document_id long, chunk_no long, chars long")
    got = {(r.document_id, r.chunk_no): r.chars for r in rp.literature_budget(docs, chunks, 5, 4000, 2).collect()}
    # first document: 2000 budget, 100 + 633 used, 633 per chunk; the second gets all that is left
    assert got == {(1, 1): 633, (1, 2): 100, (2, 1): 4000 - (100 + 633 + 633 + 100) - 60}


# ---- vectors -------------------------------------------------------------------------------------

def _vectors(spark, n=60, dup=True):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, n)] + 0.35 * rng.normal(size=(n, 8))
    if dup:
        v[1::7] = v[0]
    return v, spark.createDataFrame([(i, i % 9, v[i].tolist()) for i in range(n)], "id long, document_id long, vector array<double>")


def _plain_linkage(v, t):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = {i: [i] for i in range(len(v))}
    while len(groups) > 1:
        keys = sorted(groups)
        best = min((round(float(np.mean([1 - u[a] @ u[b] for a in groups[i] for b in groups[j]])), 10), i, j) for x, i in enumerate(keys) for j in keys[x + 1:])
        if not best[0] < t:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("local_limit", [2000, 1])
def test_clusters_match_plain_average_linkage(spark, local_limit):
    v, df = _vectors(spark, 40)
    for t in (0.2, 0.6):
        got = {}
        for r in cl.cluster(df, t, local_limit=local_limit).collect():
            got.setdefault(r.cluster, []).append(r.id)
        assert sorted(sorted(g) for g in got.values()) == _plain_linkage(v, t)


def test_cosine_pairs_in_small_blocks(spark):
    v, df = _vectors(spark, 70, dup=False)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if 1 - u[i] @ u[j] < 0.4}
    assert {(r.a, r.b) for r in cl.cosine_pairs(df, 0.4, block_rows=8).collect()} == want


def test_nearest_pairs_with_copies(spark):
    v, df = _vectors(spark, 30)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = sorted((math.floor(max(0.0, 1 - float(u[i] @ u[j])) * 1e9 + 0.5) / 1e9, i, j) for i in range(30) for j in range(i + 1, 30) if i % 9 != j % 9)
    got = [(r.left_id, r.right_id) for r in cl.nearest_pairs(df, 8, 1.0).orderBy("distance", "left_id", "right_id").collect()]
    assert got == [(i, j) for _, i, j in d[:8]]


def test_knn_blocks_equal_broadcast(spark, monkeypatch):
    _, df = _vectors(spark, 50)
    q = df.where("id < 12").select(F.col("id").alias("query_id"), "vector")
    rows = lambda x: sorted((r.query_id, r.id, r.score, r.rank) for r in x.collect())
    a = rows(rt.knn(df, q, 5, 0.3, exclude_self=True))
    monkeypatch.setattr(rt, "QUERY_BROADCAST_ROWS", 3)
    monkeypatch.setattr(rt, "BLOCK_ROWS", 7)
    assert rows(rt.knn(df, q, 5, 0.3, exclude_self=True)) == a


def test_projection_keeps_variance(spark):
    v, df = _vectors(spark, 60)
    p = np.array([r.components for r in cl.project(df, 3).orderBy("id").collect()])
    s = np.linalg.svd(v - v.mean(axis=0), compute_uv=False)
    assert np.allclose(p.var(axis=0) * len(v), s[:3] ** 2)


@pytest.mark.parametrize("local_limit", [1000, 1])
def test_one_tree_cut_at_every_height(spark, local_limit):
    """Copies, ties and families of vectors: each cut equals plain linkage there, and a merge is never below one it takes in."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    v = np.concatenate([centres[rng.integers(0, 6, 34)] + rng.normal(size=(34, 5)) * rng.uniform(0.1, 0.9, (34, 1)), centres[:3], centres[:3]])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vector array<double>")
    heights = [0.05, 0.15, 0.3, 0.5, 0.8]
    got = {}
    for r in cl.clusters_at(df, heights, local_limit).collect():
        got.setdefault(r.threshold, {}).setdefault(r.cluster, []).append(r.id)
    for t in heights:
        assert sorted(sorted(g) for g in got[t].values()) == _plain_linkage(v, t)
        assert all(min(g) == c for c, g in got[t].items())
    points = cl.collapse_copies(df)[0]
    tree = cl.merge_tree(points, 0.8, local_limit).collect()
    assert len({r.gone for r in tree}) == len(tree) == points.count() - len(got[0.8])
    own = {r.gone: r.height for r in tree}
    assert all(r.keep < r.gone and (r.keep not in own or own[r.keep] >= r.height) for r in tree)
    with pytest.raises(ValueError):
        cl.clusters_at(df, [0.5, 0.0])
    assert cl.clusters_at(df.limit(0), [0.5]).count() == 0


def test_nearest_pairs_are_bounded_by_those_of_some_vectors(spark, monkeypatch):
    v, df = _vectors(spark, 60)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = sorted((math.floor(max(0.0, 1 - float(u[i] @ u[j])) * 1e9 + 0.5) / 1e9, i, j) for i in range(60) for j in range(i + 1, 60) if i % 9 != j % 9)
    limits, pairs = [], cl.cosine_pairs
    monkeypatch.setattr(cl, "cosine_pairs", lambda x, limit, *a: limits.append(limit) or pairs(x, limit, *a))
    monkeypatch.setattr(cl, "BOUND_ROWS", 30, raising=False)
    got = [(r.left_id, r.right_id) for r in cl.nearest_pairs(df, 8, 1.0).orderBy("distance", "left_id", "right_id").collect()]
    assert got == [(i, j) for _, i, j in d[:8]] and limits[-1] < 0.9


def test_phrases_of_ids_with_few_and_many_texts_count_alike(spark, monkeypatch):
    rnd = random.Random(11)
    words = ["blight", "copper", "with", "late-", "mycelium", "zoospore", "root"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in (1, 2, 2, 3, 3, 3, None, None)] + [(4, None)]
    df = spark.createDataFrame([(i, t and t.split(" ")[0], t) for i, t in rows], "document_id long, title string, text string")
    moved, sums = [], tp._phrase_sums
    monkeypatch.setattr(tp, "_phrase_sums", lambda d: moved.append(sorted(str(r[0]) for r in d.select("document_id").collect())) or sums(d))
    counts = lambda: sorted((str(r.document_id), r.n, r.phrase, r.score, r.first, r.title_words) for r in tp.phrase_scores(df).collect())
    got = counts()
    assert moved == [["1", "2", "2", "3", "3", "3", "4"], ["None", "None"]]
    monkeypatch.setattr(tp, "SAME_ID_TEXTS", 0)
    assert got and counts() == got
    want = {}
    for i, text in rows:
        kept = [w for w in ((x.strip("-")) for x in (text or "").split()) if len(w) >= 4 and w != "with"]
        title = (text or "").split(" ")[0]
        for n in (1, 2, 3):
            for p in range(len(kept) - n + 1):
                hits = sum(w == title for w in kept[p:p + n])
                old = want.get((str(i), n, " ".join(kept[p:p + n])), (0, p, 0))
                want[str(i), n, " ".join(kept[p:p + n])] = (old[0] + 1 + 2 * hits, min(old[1], p), max(old[2], hits))
    assert got == sorted((*k, *v) for k, v in want.items())
