"""Phrases of texts that share an id, counted in pieces, against plain loops."""

import re
from collections import defaultdict

import pytest

from litquarry.operators import topics as tp


def _plain(rows):
    found = defaultdict(lambda: [0, 10**9, 0])
    for doc, title, text in rows:
        words = [w for w in (x.lower().strip("-") for x in re.findall(r"[A-Za-z][A-Za-z-]{2,}", text or "")) if w not in tp.STOPWORDS and len(w) >= 4]
        named = set(re.findall(r"[a-z][a-z-]{2,}", (title or "").lower()))
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                phrase = " ".join(words[i:i + n])
                if 4 <= len(phrase) <= 60:
                    hits = sum(w in named for w in words[i:i + n])
                    f = found[doc, n, phrase]
                    f[:] = f[0] + 1 + 2 * hits, min(f[1], i), max(f[2], hits)
    return sorted((str(k[0]), *k[1:], *v) for k, v in found.items())


@pytest.mark.parametrize("piece, same_id", [(1 << 18, 32), (7, 32), (1 << 18, 1)])
def test_phrases_of_texts_with_one_id(spark, monkeypatch, piece, same_id):
    monkeypatch.setattr(tp, "SAME_ID_TEXTS", same_id)
    if piece != tp.PHRASE_WORDS:  # workers import the module anew, so the pieces are cut here
        import numpy as np
        import pyarrow as pa
        words = [["root", "rot", "root"], [], None, ["seed", "root", "rot", "seed", "cell"], ["rots"] * 9]
        batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 3]), pa.array(words, pa.list_(pa.string())), pa.array([["root"], [], [], ["seed"], None], pa.list_(pa.string()))],
                                           names=["document_id", "_w", "_t"])
        want = sorted(map(str, (r for b in tp._count_phrases(batch, np.array([0, 2, 4])) for r in b.to_pylist())))
        monkeypatch.setattr(tp, "PHRASE_WORDS", piece)
        assert sorted(map(str, (r for b in tp._count_phrases(batch, np.array([0, 2, 4])) for r in b.to_pylist()))) == want and len(want) > 10
        return
    rows = [(1, "Root rots", "root rot of Seed-- lings, root rot"), (1, "Seedlings", "seedlings root rots and root-rot"), (2, None, "cell wall Éclair walls cell wall"), (3, "x", None),
            (None, "late", "late blight late blight"), (2, "wall", "wall walls wall"), (4, "", "that this " * 4), (5, "long", " ".join(f"word{'abcdefgh'[i % 8] * 20}" for i in range(50)))]
    df = spark.createDataFrame(rows, "document_id long, title string, text string")
    found = tp.phrase_scores(df).select("document_id", "n", "phrase", "score", "first", "title_words").collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == _plain(rows)


def test_words_of_a_title_are_not_copied_to_each_phrase(spark):
    df = spark.createDataFrame([(1, "root rot", "root rot")], "document_id long, title string, text string")
    plan = tp.phrase_scores(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
