"""Scans over long groups: composition of block functions, and one section of a million units."""

import random

import pytest
from pyspark.sql import functions as F

from litquarry.operators import chunking as ck
from litquarry.operators.scan import entry_states, runs
from litquarry.scale import is_small


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_entry_states_equal_a_plain_chain(spark, fan):
    rng = random.Random(fan)
    links, want = [], {}
    for group, blocks in (("a", 1), ("b", 2), ("c", 9), ("d", 41)):
        state, count = 3, 0
        for b in range(blocks):
            own = [(s, rng.randrange(6), rng.randrange(4)) for s in range(6)]
            links.append((group, b, *runs(own)))
            want[group, b] = (state, count)
            state, count = own[state][1], count + own[state][2]
    df = spark.createDataFrame(links, "g string, _b long, _in array<long>, _out array<long>, _add array<long>")
    got = {(r.g, r._b): (r._entry, r._count) for r in entry_states(df, ["g"], 3, fan).collect()}
    assert got == want


def test_a_section_of_a_million_units(spark):
    """Sizes repeat with an odd period, so no two blocks look alike; compared with one plain loop over the sizes."""
    n = 1_000_000
    units = spark.range(n).select(F.lit(7).cast("long").alias("document_id"), F.col("id").alias("ord"), F.lit("body").alias("content_type"), F.lit("S").alias("section_path"),
                                  F.lit(0).alias("paragraph"), F.col("id").cast("int").alias("sentence"), F.expr("repeat('x', cast(1 + pow(id, 2) % 1013 as int))").alias("text"))
    got = [tuple(r) for r in ck.chunk(units).orderBy("chunk_no").select("chunk_no", "first_ord", "n_units", F.length("text")).collect()]
    head = len("Section: S\n")
    size = [1 + i * i % 1013 for i in range(n)]
    want, s, e, total = [], 0, 1, size[0]
    tokens = lambda chars: -(-(head + chars) // 4)
    while True:
        while e < n and (tokens(total + 1 + size[e]) <= 700 or (tokens(total + 1 + size[e]) <= 900 and tokens(total) < 350)):
            total, e = total + 1 + size[e], e + 1
        want.append((len(want) + 1, s, e - s, total))
        if e == n:
            break
        s, total = max(s, e - 1), size[max(s, e - 1)]
        if tokens(total + 1 + size[e]) > 900:
            s, total = e, size[e]
        e = max(s + 1, e + 1) if s < e else e + 1
        total = sum(size[s:e]) + (e - s - 1)
    assert got == want


def test_scan_has_no_task_for_a_whole_group(spark):
    units = spark.createDataFrame([(1, i, "body", "S", 0, i, "a b.") for i in range(40)], "document_id long, ord long, content_type string, section_path string, paragraph int, sentence int, text string")
    plan = ck.chunk(units, block=8)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_broadcasts_are_weighed(spark):
    texts = spark.createDataFrame([(1, "x" * 900, [1, 2], None), (2, None, None, {"a": 1})], "k long, t string, `a.b` array<int>, m map<string,int>")
    assert is_small(texts) and not is_small(texts, max_rows=1) and not is_small(texts, max_bytes=900) and is_small(texts.select("k"), max_bytes=0)
    assert is_small(texts.limit(0), 0, 0)
