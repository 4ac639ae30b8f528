"""Conversation structure repair: cheapest edits that make the roles of a conversation take turns, by block tables.

Roles after the repair are empty, or an optional system row followed by pairs of user and assistant. The least cost to
finish from each of the four places in that pattern is a vector; going backward over a row changes the vector by a rule
that depends on the row's symbol only. Less its minimum the vector takes few values, so the change over every block of
BLOCK symbols is precomputed for all of them (Four Russians). Conversations are processed backward block by block by
lookup; then each block is expanded backward into the vectors between its rows and traced forward, taking the least
letter among the edits that keep the least cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from litquarry.llm.common import bounded_batches
from litquarry.operators.scan import entry_states
from litquarry.scale import cut, global_rank

BLOCK = 4  # symbols of a table entry
SEGMENT = 4096  # rows of a conversation that one task works on
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
WHITE_END = r"[.!?][\x20\x09-\x0D]*\z"
VISIBLE = r"[^\x20\x09-\x0D]"
# places in the pattern: nothing yet, after the system row, after a user row, after an assistant row (or its end)
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled row leads
GIVES = ("user", "user", "assistant", "user")  # and its role
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
END = (0, 2 * INSERT, INSERT, 0)
INITIALS = "sua"  # other initials: number 3
FAULTS = 3  # a row's symbol: FAULTS * initial + (0 sound, 1 truncated, 2 must go)
_DROP = 8  # the symbol within the tables of a row that must go; else 2 * initial + truncated
_SYMBOLS = 9


def _table_symbol(symbol: int) -> int:
    initial, fault = divmod(symbol, FAULTS)
    return _DROP if fault == 2 else 2 * initial + fault


def _back(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost from each place with one more row in front."""
    initial, truncated = divmod(symbol, 2)
    cost = []
    for q in range(4):
        least = DELETE + after[q]
        if symbol != _DROP:
            least = min(least, REROLE + truncated + after[NEXT[q]])
            if (q, initial) in KEEP:
                least = min(least, truncated + after[KEEP[q, initial]])
        cost.append(least)
    for _ in range(3):  # rows may be inserted in front of it
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


class Tables:
    """All cost vectors less their minimum that rows can lead to, and the change over every block of symbols."""

    def __init__(self):
        self.vectors = [END]  # its minimum is 0
        number, rows = {END: 0}, []
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(_SYMBOLS):
                cost = _back(symbol, vector)
                least = min(cost)
                short = tuple(c - least for c in cost)
                if short not in number:
                    number[short] = len(self.vectors)
                    self.vectors.append(short)
                row.append((number[short], least))
            rows.append(row)
        one = np.array(rows, np.int64)  # vector, symbol, (next vector, cost)
        self.step = one[:, :, 0].T.copy(), one[:, :, 1].T.copy()  # symbol, vector
        to, cost = np.arange(len(rows))[None, :], np.zeros((1, len(rows)), np.int64)
        for _ in range(BLOCK):  # a symbol in front of every block so far
            to, cost = (np.concatenate([self.step[0][s][to] for s in range(_SYMBOLS)]),
                        np.concatenate([cost + self.step[1][s][to] for s in range(_SYMBOLS)]))
        self.to, self.cost = to, cost  # block, vector
        self.traced: dict[tuple, tuple] = {}

    def split(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Numbers of the whole blocks, and the symbols behind them."""
        whole = len(symbols) // BLOCK * BLOCK
        blocks = np.array(symbols[:whole], np.int64).reshape(-1, BLOCK)
        return (blocks @ (_SYMBOLS ** np.arange(BLOCK)[::-1])).tolist(), symbols[whole:]

    def backward(self, symbols: list[int], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cost) in front of the rows for every vector behind them."""
        blocks, rest = self.split(symbols)
        cost = np.zeros(len(vectors), np.int64)
        for s in reversed(rest):
            cost, vectors = cost + self.step[1][s][vectors], self.step[0][s][vectors]
        for b in reversed(blocks):
            cost, vectors = cost + self.cost[b][vectors], self.to[b][vectors]
        return vectors, cost

    def trace(self, symbols: list[int], behind: int, place: int) -> tuple[list[str], int]:
        """For every row its edits (inserts in front of it, then its own), and the place behind the last row."""
        blocks, rest = self.split(symbols)
        ends = [behind]
        for s in reversed(rest):
            ends.append(int(self.step[0][s][ends[-1]]))
        ends = [ends[-1]]
        for b in reversed(blocks[1:]):
            ends.append(int(self.to[b][ends[-1]]))
        out: list[str] = []
        for k, b in enumerate(blocks):
            end = ends[len(blocks) - 1 - k]
            key = (b, end, place)
            if key not in self.traced:
                self.traced[key] = self._expand(symbols[k * BLOCK:(k + 1) * BLOCK], end, place)
            edits, place = self.traced[key]
            out += edits
        edits, place = self._expand(rest, behind, place)
        return out + edits, place

    def _expand(self, symbols: list[int], behind: int, place: int) -> tuple[list[str], int]:
        """The vectors between the rows from the last to the first, then the least letters from the first to the last."""
        after = [self.vectors[behind]]
        for s in reversed(symbols):
            after.append(_back(s, after[-1]))
        out = []
        for i, s in enumerate(symbols):
            now, then = after[len(symbols) - i], after[len(symbols) - i - 1]
            initial, truncated = divmod(s, 2)
            edits = ""
            while now[place] != DELETE + then[place] and now[place] == INSERT + now[NEXT[place]]:
                edits += "I"
                place = NEXT[place]
            if now[place] == DELETE + then[place]:
                edits += "D"
            elif s != _DROP and (place, initial) in KEEP and now[place] == truncated + then[KEEP[place, initial]]:
                edits, place = edits + "K", KEEP[place, initial]
            else:
                edits, place = edits + "R", NEXT[place]
            out.append(edits)
        return out, place


@cache
def tables() -> Tables:
    return Tables()


def end_inserts(place: int) -> str:
    """Inserts that finish the pattern behind the last row."""
    return "I" * (END[place] // INSERT)


def cheapest_edits(symbols: list[int]) -> tuple[str, int]:
    """(edits, cost) of one short list of row symbols (FAULTS * initial + fault)."""
    t, own = tables(), [_table_symbol(s) for s in symbols]
    first, cost = t.backward(own, np.array([0]))
    edits, place = t.trace(own, 0, START)
    return "".join(edits) + end_inserts(place), int(cost[0]) + t.vectors[first[0]][START]


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: _c (conv_id as text, null as a space), turn, role, text; nulls in role and text are spaces.

    crc32 of ``conv_id:turn`` modulo 20 drops a row (0), empties its text (1), removes its sentence ends (2), gives it
    twice (3) or makes its role user (4).
    """
    own = conversations.select(_spaced(F.col("conv_id")).alias("_c"), F.col("turn"), _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"),
                               (F.crc32(F.concat_ws(":", _spaced(F.col("conv_id")), _spaced(F.col("turn")))) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.where("_d <> 0").select("_c", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                       F.explode(copies).alias("_copy"))


def _symbols(ranked: DataFrame) -> DataFrame:
    """(_c, turn, pos, initial, fault) of every row; duplicates are found by the first position of each role and text."""
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(len(INITIALS) + 1)) - 1
    initial = F.when(F.length("role") == 0, len(INITIALS)).otherwise(initial)
    slim = cut(ranked.select("_c", "turn", "pos", initial.alias("initial"), (~F.col("text").rlike(VISIBLE)).alias("blank"),
                             (~F.col("text").rlike(WHITE_END)).alias("open"), F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256).alias("_same")))
    first = slim.groupBy("_c", "_same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("open"), "truncated")
    return slim.join(first, "pos", "left").select("_c", "turn", "pos", "initial", fault.alias("fault"))


def _segments(symbols: DataFrame) -> DataFrame:
    """(_c, _b, symbols): rows of a conversation in runs of at most SEGMENT, a character for each row, _b from 0."""
    kind = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    coded = symbols.select("_c", "pos", F.floor(F.col("pos") / SEGMENT).alias("_s"), F.char(F.lit(65) + FAULTS * F.col("initial") + kind).alias("code"))
    runs = coded.groupBy("_c", "_s").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("l"))
    runs = runs.select("_c", "_s", F.array_join(F.transform("l", lambda x: x["code"]), "").alias("symbols"))
    bounds = runs.groupBy("_c").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    return cut(runs.join(bounds, "_c").select("_c", "_s", (F.col("_s") - F.col("_lo")).alias("_b"), (F.col("_hi") - F.col("_lo")).alias("_last"), "symbols"))


def _decoded(symbols: str) -> list[int]:
    return [_table_symbol(b - 65) for b in symbols.encode()]


def _links(segments: DataFrame, number: Column, function, *extra: str) -> DataFrame:
    """Summaries (group, block, entries, exits, increments) of segments for ``entry_states``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [function(row) for row in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame({"_c": pdf["_c"], "_b": pdf["_n"], "_in": [list(range(len(o[0]))) for o in out], "_out": [o[0] for o in out], "_add": [o[1] for o in out]})

    own = segments.select("symbols", *extra, "_c", number.alias("_n"))
    return own.mapInPandas(run, "_c string, _b long, _in array<long>, _out array<long>, _add array<long>")


def _edits(segments: DataFrame) -> DataFrame:
    """(_c, _s, edits of every row, inserts behind the last row, illegal neighbours, cost) of every segment.

    Conversations of several segments are chained twice by composing what each segment does to every state: from the
    last one to the first for the cost vectors, then forward for the place in the pattern.
    """
    several = segments.where("_last > 0")
    if several.isEmpty():
        ready = segments.withColumn("_behind", F.lit(0).cast("long")).withColumn("_place", F.lit(START).cast("long"))
    else:
        def back(row):
            to, cost = tables().backward(_decoded(row[0]), np.arange(len(tables().vectors)))
            return to.tolist(), cost.tolist()

        behind = entry_states(_links(several, F.col("_last") - F.col("_b"), back), ["_c"], start=0).select("_c", F.col("_b").alias("_n"), F.col("_entry").alias("_behind"))
        known = cut(several.withColumn("_n", F.col("_last") - F.col("_b")).join(behind, ["_c", "_n"]).drop("_n"))

        def forth(row):
            own = _decoded(row[0])
            return [tables().trace(own, int(row[1]), q)[1] for q in range(4)], [0] * 4

        places = entry_states(_links(known, F.col("_b"), forth, "_behind"), ["_c"], start=START).select("_c", "_b", F.col("_entry").alias("_place"))
        short = segments.where("_last = 0").withColumn("_behind", F.lit(0).cast("long")).withColumn("_place", F.lit(START).cast("long"))
        ready = short.unionByName(known.join(places, ["_c", "_b"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        legal = {(0, 1), (1, 2), (2, 1)}
        for pdf in batches:
            out = []
            for symbols, behind, place, last in zip(pdf["symbols"], pdf["_behind"], pdf["_place"], pdf["_b"] == pdf["_last"]):
                raw = [b - 65 for b in symbols.encode()]
                edits, end = tables().trace([_table_symbol(s) for s in raw], int(behind), int(place))
                tail = end_inserts(end) if last else ""
                cost = INSERT * len(tail)
                for s, e in zip(raw, edits):
                    cost += INSERT * (len(e) - 1) + (DELETE if e[-1] == "D" else TRUNCATED * (s % FAULTS == 1) + REROLE * (e[-1] == "R"))
                initials = [s // FAULTS for s in raw]
                out.append((edits, tail, int(place), sum(p not in legal for p in zip(initials, initials[1:])), cost, initials[0], initials[-1]))
            yield pd.DataFrame({"_c": pdf["_c"], "_s": pdf["_s"], "_b": pdf["_b"],
                                **{n: [o[i] for o in out] for i, n in enumerate(("edits", "tail", "place", "illegal", "cost", "first", "last"))}})

    columns = ready.select("_c", "_s", "_b", "_last", "symbols", "_behind", "_place")
    return cut(columns.mapInPandas(run, "_c string, _s long, _b long, edits array<string>, tail string, place long, illegal long, cost long, first int, last int"))


def _digests(ranked: DataFrame, edits: DataFrame) -> DataFrame:
    """(_c, audit, repaired_sha256): a conversation's rows stream past in order, and only its letters are held.

    The edits of a segment come before its rows in the same sorted partition, so texts are moved once. A hash over a
    whole text can only be taken in order, so the rows of one conversation pass through one task, a batch at a time.
    """
    rows = ranked.select("_c", F.floor(F.col("pos") / SEGMENT).alias("_s"), "pos", "role", "text", F.lit(None).cast("array<string>").alias("edits"), F.lit(None).cast("string").alias("tail"))
    heads = edits.select("_c", "_s", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edits", "tail")
    ordered = rows.unionByName(heads).repartition("_c").sortWithinPartitions("_c", "_s", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, done = None, []
        audit, digest, place, between, waiting, tail = bytearray(), hashlib.sha256(), START, b"", iter(()), ""

        def message(role: str, text: str) -> None:
            nonlocal between
            digest.update(between + role.encode("utf-8", "surrogatepass") + b":")
            digest.update(text.encode("utf-8", "surrogatepass"))
            between = b"\n"

        def apply(letters: str, role: str = "", text: str = "") -> None:
            nonlocal place
            audit.extend(letters.encode())
            for letter in letters:
                if letter == "K":
                    message(role, text)
                    place = KEEP[place, INITIALS.index(role[0])]
                elif letter != "D":
                    message(GIVES[place], text if letter == "R" else "")
                    place = NEXT[place]

        def finish() -> None:
            apply(tail)
            done.append((current, audit.decode(), digest.hexdigest()))

        for pdf in batches:
            for c, pos, role, text, letters, ending in zip(pdf["_c"], pdf["pos"], pdf["role"], pdf["text"], pdf["edits"], pdf["tail"]):
                if c != current:
                    if current is not None:
                        finish()
                    current, audit, digest, place, between, tail = c, bytearray(), hashlib.sha256(), START, b"", ""
                if pos < 0:
                    waiting, tail = iter(letters), ending
                else:
                    apply(next(waiting), role, text)
            if done:
                yield pd.DataFrame(done, columns=["_c", "audit", "repaired_sha256"])
                done.clear()
        if current is not None:
            finish()
            yield pd.DataFrame(done, columns=["_c", "audit", "repaired_sha256"])

    return ordered.mapInPandas(run, "_c string, audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id (null is one, too): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged as ``damaged`` says and taken by turn, null turns first, equal turns by role and text. A conversation
    of any length is cut to segments of SEGMENT rows that different tasks work on. A conversation without a row after
    damage has zeros, an empty audit and the hash of nothing. Other columns are not read.
    """
    bounded_batches(conversations.sparkSession)
    after = damaged(conversations)
    ranked = global_rank(after, [], [F.col("_c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_copy")], "pos")
    symbols = cut(_symbols(ranked))
    edits = _edits(_segments(symbols))
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    turns = symbols.where("turn is not null").groupBy("_c", "turn").agg(F.lit(1).alias("_one")).groupBy("_c").agg(
        (F.max("turn").cast("decimal(21,0)") - F.min("turn").cast("decimal(21,0)") + 1 - F.count("_one")).alias("_gaps"))
    faults = symbols.groupBy("_c").agg(count("blank"), count("duplicate"), count("truncated"))
    behind = edits.select("_c", (F.col("_b") + 1).alias("_b"), F.col("last").alias("_before"))
    pair = F.concat_ws("", F.col("_before").cast("string"), F.col("first").cast("string"))
    joints = edits.join(behind, ["_c", "_b"]).groupBy("_c").agg(F.count(F.when(~pair.isin("01", "12", "21"), 1)).alias("_joints"))
    costs = edits.groupBy("_c").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    out = conversations.select("conv_id").distinct().withColumn("_c", _spaced(F.col("conv_id")))
    for part in (faults, turns, costs, joints, _digests(ranked, edits)):
        out = out.join(part, "_c", "left")
    number = lambda c: F.coalesce(c.cast("long"), F.lit(0)).cast("long")
    most = F.lit((1 << 63) - 1).cast("decimal(21,0)")
    gaps = F.when(F.col("_gaps") > most, most).otherwise(F.col("_gaps"))
    return out.select(
        "conv_id", number(gaps).alias("gaps"), number(F.col("blank")).alias("blank"), number(F.col("duplicate")).alias("duplicate"),
        number(F.col("truncated")).alias("truncated"), (number(F.col("illegal")) + number(F.col("_joints"))).alias("illegal"), number(F.col("cost")).alias("cost"),
        F.coalesce(F.col("audit"), F.lit("")).alias("audit"), F.coalesce(F.col("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
