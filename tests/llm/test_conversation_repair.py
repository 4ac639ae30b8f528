"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache
from itertools import product

import pytest

from litquarry.llm import conversation_repair as cr, queries  # noqa: F401
from litquarry.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, pos int, edits string"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, [])
        out[conv] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = VISIBLE.findall(text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(symbols):
    """(cost, audit, output roles) by trying every edit; symbols are (initial, fault)."""
    def follow(given, r):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((given, r))

    @cache
    def best(i, last, inserted):
        options = [(0, "")] if i == len(symbols) and last in ("", "a") else []
        if inserted < 3:
            options += [(2 + c, "I" + a) for r in "ua" if follow(last, r) for c, a in [best(i, r, inserted + 1)]]
        if i < len(symbols):
            initial, fault = symbols[i]
            c, a = best(i + 1, last, 0)
            options.append((3 + c, "D" + a))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if follow(last, initial):
                    c, a = best(i + 1, initial, 0)
                    options.append((extra + c, "K" + a))
                for r in "ua":
                    if follow(last, r):
                        c, a = best(i + 1, r, 0)
                        options.append((2 + extra + c, "R" + a))
        return min(options, default=(10 ** 9, ""))

    return best(0, "", 0)


def replay(rows, audit):
    out, rest, last = [], iter(rows), ""
    for letter in audit:
        want = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if letter == "I":
            out.append((want, ""))
        else:
            _, role, text = next(rest)
            if letter == "D":
                continue
            out.append((role, text) if letter == "K" else (want, text))
        last = out[-1][0][0]
    assert LEGAL.match("".join(r[0] for r, _ in out))
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode("utf-8", "surrogatepass")).hexdigest()


def plain(rows):
    out = []
    for conv, own in damaged(rows).items():
        bad = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(zip(initials, bad)))
        out.append((conv, gaps, *(bad.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, replay(own, audit)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted([tuple(r[c] for c in COLUMNS) for r in cr.repair(df).collect()], key=repr)


def test_every_short_list_of_symbols():
    """Cost and letters of the tables equal the search over all edits, ties included."""
    kinds = list(product("suax", (None, "truncated"))) + [("u", "blank")]
    code = lambda s: 3 * "suax".index(s[0]) + {None: 0, "truncated": 1, "blank": 2}[s[1]]
    rng = random.Random(2)
    lists = [list(p) for n in range(4) for p in product(kinds, repeat=n)]
    lists += [[rng.choice(kinds) for _ in range(rng.randint(4, 23))] for _ in range(1500)]
    for symbols in lists:
        cost, audit = cheapest(tuple(symbols))
        assert cr.cheapest_edits([code(s) for s in symbols]) == (audit, cost), symbols


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    got = sorted([tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, FOLDER).collect()], key=repr)
    assert got == plain(rows)


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Hi.", "What?", "open end", "", " \n", None, "é. ", "Done!\x0b", "no\nend", "Hi.", "a:b\nuser:c."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Über", "u"]
    return [(rng.choice([None, 1, 2, 3, *range(10, 30)]), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("segment", [4096, 8])
def test_against_plain_loops(spark, segment, monkeypatch):
    """Nulls in all columns, repeated rows and turns; short segments chain long conversations over many tasks."""
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = conversations(segment, 500) + [(99, t, "user" if t % 2 else "assistant", f"row {t % 50}{'.' * (t % 3)}") for t in range(300)]
    rows += [(102, None, "user", "a"), (102, None, "assistant", "b."), (100, (1 << 63) - 1, "user", "far."), (100, -(1 << 63), "assistant", "off."), (101, 4, "user", "x" * 200_000 + ".")]
    sys.setrecursionlimit(20_000)
    assert run(spark, rows) == [(r[0], min(r[1], (1 << 63) - 1), *r[2:]) for r in plain(rows)]


def test_empty_and_vanishing(spark):
    assert run(spark, []) == []
    gone = [(c, t, "user", "a.") for c in range(200) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    nothing = hashlib.sha256(b"").hexdigest()
    assert gone and run(spark, gone) == sorted([(c, 0, 0, 0, 0, 0, 0, "", nothing) for c, *_ in gone], key=repr)
