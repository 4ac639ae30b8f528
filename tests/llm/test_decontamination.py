"""The positional index against plain loops; the SQL of its query is compared in test_operators."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from litquarry.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(dc.UPPER, dc.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, size=10):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, word string, term int")
    b = spark.createDataFrame([(a, b, None) for a, b in items], "item_id long, text string, wid long")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted([tuple(r[c] for c in cols) for r in dc.decontaminate(d, b, size).collect()], key=repr)


@pytest.mark.parametrize("size", [1, 2, 4, 10])
def test_against_plain_loops(spark, size):
    rng = random.Random(size)
    vocabulary = ["a", "B", "c", "dé", "É", "the", "THE", "x9"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "--", "\x00", "\x7f"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(12)] + [(3, text(5)), (3, None), (None, "a a a"), (20, ""), (21, " . "), (22, "a a a a a a a a a a a")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, text(4) + (items[i][1] or "") + text(3)) for i in range(10)]
    docs += [(5, "repeated id"), (5, docs[45][1]), docs[45], docs[45], (None, docs[44][1]), (None, None), (7, None), (8, ""), (9, " \n "), (11, "a " * 3000)]
    assert run(spark, docs, items, size) == plain(docs, items, size)


def test_empty_tables(spark):
    docs, items = [(1, "one two"), (2, None)], [(1, "one two")]
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == plain(docs, [])
    assert run(spark, docs, [(1, None), (2, "...")]) == plain(docs, [])


def test_a_passage_in_most_documents(spark):
    """One passage and one word fill the index; every copy is found and no task needs them all."""
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"start{i} the the {passage} the end{i}") for i in range(400)] + [(1000, "the " * 20_000)]
    items = [(1, passage), (2, "the the w0 w1 w2 w3 w4 w5 w6 w7 w8"), (3, "the " * 12)]
    assert run(spark, docs, items) == plain(docs, items)


def test_proximity(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(25)]
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 200))) for _ in range(30)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    windows, _ = dc.item_windows(b, 4)
    terms = dc.term_numbers(windows)
    index = dc.build_index(d, terms)
    number = {r.word: r.term for r in terms.collect()}
    count = {w: sum(t.split().count(w) for t in docs) for w in vocabulary}
    reach, want = 6, set()
    for r in windows.collect():
        rarest = min(r.words, key=lambda w: (count[w], number[w]))
        for i, t in enumerate(docs):
            w = t.split()
            for p in range(len(w)):
                if w[p] == rarest and set(r.words) <= set(w[max(0, p - reach):p + reach + 1]):
                    want.add((r.wid, i, p + 1))
    ids = {r.row: r.doc_id for r in index.where("term = 0").collect()}
    got = [(r.wid, ids[r.row], r.pos) for r in dc.proximity_matches(index, windows, terms, reach).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    phrases = {(r.wid, ids[r.row]) for r in dc.phrase_matches(index, windows, terms).collect()}
    assert phrases <= {(w, i) for w, i, _ in want} and len(phrases) > 3


def test_lookups_shuffle_no_text(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    windows, _ = dc.item_windows(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    index = dc.build_index(docs, dc.term_numbers(windows))
    assert index.columns == ["term", "row", "pos", "doc_id", "n_words"]
    assert index.where(F.col("term") == 0).count() == 1
