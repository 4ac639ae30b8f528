"""Sentence-packing chunker, overlapping windows, batch packing and batch context."""

from __future__ import annotations

import math
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from litquarry.functions.core import is_blank
from litquarry.functions.pages import contains_any
from litquarry.operators.scan import BLOCK, blocked_scan, jump_summary
from litquarry.scale import cut, global_rank

TARGET_TOKENS, MAX_TOKENS, OVERLAP = 700, 900, 1
CONTEXT_SECTIONS = ["abstract", "摘要", "method", "材料", "方法", "result", "结果", "table", "figure"]


def _tokens(ascii_chars: float, wide: float) -> int:
    return max(1, math.ceil(ascii_chars / 4) + int(wide)) if ascii_chars + wide > 0 else 0


def _ascii(text: str) -> int:
    return len(text.encode("ascii", "ignore"))


def split_units(units: DataFrame, title: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Units longer than a chunk become several parts at white space; ``part`` numbers them.

    ``units(document_id, ord, content_type, section_path, paragraph, sentence, text[, title])``. Sizes are counted by
    column functions; only the units that are too long are read by Python.
    """
    def parts(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                *fields, base_ascii, base_wide = row
                a = w = n = 0
                words: list[str] = []
                for word in re.split(r"\s+", fields.pop()):
                    wa, ww = _ascii(word), len(word) - _ascii(word)
                    gap = 1 if words else 0
                    if words and _tokens(base_ascii + a + gap + wa, base_wide + w + ww) > max_tokens:
                        out.append((*fields, " ".join(words), n))
                        n, words, a, w, gap = n + 1, [], 0, 0, 0
                    words.append(word)
                    a, w = a + gap + wa, w + ww
                if words:
                    out.append((*fields, " ".join(words), n))
            yield pd.DataFrame(out, columns=[*others, "text", "part"])

    others = [n for n in units.columns if n != "text"]
    too_long, head = _size_of(units) > max_tokens, _head(units.columns)
    wide = _wide_chars(head)
    oversized = units.where(too_long).select(*others, "text", (F.length(head) - wide).alias("_ha"), wide.alias("_hw"))
    schema = T.StructType([units.schema[n] for n in [*others, "text"]] + [T.StructField("part", T.IntegerType())])
    return units.where(~too_long).withColumn("part", F.lit(0)).unionByName(oversized.mapInPandas(parts, schema))


def _wide_chars(text: Column) -> Column:
    """Code points outside ASCII, each of which counts as a token."""
    return F.length(F.regexp_replace(text, "[\\x00-\\x7F]+", ""))


def _head(columns: list[str]) -> Column:
    """The lines in front of every chunk of a section."""
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in columns else F.lit("")
    section = F.coalesce(F.col("section_path"), F.lit(""))
    return F.concat(F.when(is_blank(title), "").otherwise(F.concat(F.lit("Paper: "), title, F.lit("\n"))),
                    F.when(is_blank(section), "").otherwise(F.concat(F.lit("Section: "), section, F.lit("\n"))))


def _size_of(units: DataFrame) -> Column:
    whole = F.concat(_head(units.columns), F.col("text"))
    wide = _wide_chars(whole)
    return F.ceil((F.length(whole) - wide) / 4) + wide


CHUNK_SCHEMA = T.StructType([
    T.StructField("document_id", T.LongType()), T.StructField("content_type", T.StringType()),
    T.StructField("section_path", T.StringType()), T.StructField("chunk_no", T.LongType()),
    T.StructField("first_ord", T.LongType()), T.StructField("paragraph", T.IntegerType()),
    T.StructField("sentence_start", T.IntegerType()), T.StructField("sentence_end", T.IntegerType()),
    T.StructField("n_units", T.IntegerType()), T.StructField("text", T.StringType())])


def chunk(units: DataFrame, target: int = TARGET_TOKENS, maximum: int = MAX_TOKENS, overlap: int = OVERLAP,
          block: int = BLOCK) -> DataFrame:
    """Pack consecutive units of one (document, content type, section) into chunks.

    A unit joins while the chunk stays within ``target``, or within ``maximum`` while the chunk is
    below half of ``target``; the next chunk repeats the last ``overlap`` units if they fit. Since a
    chunk is a run of units, the scan state is where the next run starts and how many of its units
    are already in, so a section of any length is packed block by block.
    """
    key = ["document_id", "content_type", "section_path"]
    cols = [*key, "title", "ord", "paragraph", "sentence", "text"]
    have = units if "title" in units.columns else units.withColumn("title", F.lit(None).cast("string"))
    have = have.na.fill("", ["content_type", "section_path"])
    parts = split_units(have.where(~is_blank("text")).select(*cols), max_tokens=maximum)
    head = _head(parts.columns)
    rows = parts.withColumn("_w", _wide_chars(F.col("text"))).withColumn("_a", F.length("text") - F.col("_w")).withColumn(
        "_hw", _wide_chars(head)).withColumn("_ha", F.length(head) - F.col("_hw")).drop("title")
    # one token is at least two characters of a unit and its blank
    reach = 4 * maximum + overlap + 1
    base = overlap + 2

    def plan(cols: dict[str, list]):
        """Function (start, units already in) -> (end, next start, next units in)."""
        ca, cw = [0, *accumulate(a + 1 for a in cols["_a"])], [0, *accumulate(cols["_w"])]
        ha, hw, n = cols["_ha"][0], cols["_hw"][0], len(cols["_a"])
        tok = lambda i, j: _tokens(ha + ca[j] - ca[i] - 1, hw + cw[j] - cw[i])

        def step(s: int, have_in: int):
            e = min(s + have_in, n)
            while e < n:
                grown = tok(s, e + 1)
                if grown <= target or (grown <= maximum and tok(s, e) < target // 2):
                    e += 1
                else:
                    break
            nxt = max(s, e - overlap) if overlap else e
            while nxt < e and e < n and tok(nxt, e + 1) > maximum:
                nxt += 1
            return e, nxt, e - nxt + 1
        return step, n

    def summarise(cols: dict[str, list], own: int):
        step, n = plan(cols)
        memo: dict[tuple[int, int], tuple[int, int]] = {}

        def leave(state):
            path = []
            while state not in memo and state[0] < own:
                path.append(state)
                e, s2, k2 = step(*state)
                state = (s2, k2) if e < n else (n, 1)
            out = memo.get(state, ((state[0] - own) * base + state[1], 0))
            for p in reversed(path):
                out = (out[0], out[1] + 1)
                memo[p] = out
            return out

        for s in range(min(own, reach)):
            for k in range(1, overlap + 2):
                yield (s * base + k, *leave((s, k)))
        for s in range(own, reach + 1):
            for k in range(1, overlap + 2):
                yield s * base + k, (s - own) * base + k, 0

    def emit(cols: dict[str, list], own: int, entry: int, count: int):
        step, n = plan(cols)
        s, k = divmod(entry, base)
        group = [cols[g][0] for g in key]
        texts, ords, paragraphs, sentence = (cols[x] for x in ("text", "ord", "paragraph", "sentence"))
        while s < own and s < n:
            e, s2, k2 = step(s, k)
            count += 1
            yield (*group, count, ords[s], paragraphs[s], sentence[s], sentence[e - 1], e - s, " ".join(texts[s:e]))
            if e >= n:
                break
            s, k = s2, k2

    packed = blocked_scan(rows, key, ["ord", "part"], summarise, emit, CHUNK_SCHEMA, start=1, block=block, halo=reach)
    return _number(cut(packed), key)  # read for numbering as well as for output


def _number(packed: DataFrame, key: list[str]) -> DataFrame:
    """Chunk numbers of the document; sections follow each other in order of their first unit."""
    first = packed.groupBy(*key).agg(F.min("first_ord").alias("_sec"), F.max("chunk_no").alias("_len"))
    w = W.partitionBy("document_id").orderBy("_sec", "content_type", "section_path")
    # one row per section, so the window is over sections rather than chunks
    offset = first.withColumn("_off", F.sum("_len").over(w) - F.col("_len"))
    out = packed.join(offset.select(*key, "_off"), key).withColumn("chunk_index", F.col("_off") + F.col("chunk_no")).drop("_off")
    return out.withColumn("chunk_id", F.concat_ws(":", "document_id", "chunk_index"))


WINDOW_SCHEMA = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("window_no", T.LongType()),
                              T.StructField("first_pos", T.LongType()), T.StructField("last_pos", T.LongType()),
                              T.StructField("chars", T.LongType())])


def analysis_windows(chunks: DataFrame, max_chunks: int = 8, max_chars: int = 28_000, overlap: int = 1,
                     block: int = BLOCK) -> DataFrame:
    """Overlapping runs of a document's chunks bounded by count and characters.

    ``chunks(document_id, chunk_index, chunk_id, text)``; positions count non-blank chunks in order.
    """
    max_chunks, max_chars = max(1, max_chunks), max(1000, max_chars)
    overlap = min(max(0, overlap), max_chunks - 1)
    rows = chunks.where(~is_blank("text")).select("document_id", "chunk_index", "chunk_id", F.length("text").alias("size"))
    return _pack(rows, ["chunk_index", "chunk_id"], WINDOW_SCHEMA, max_chunks, max_chars, overlap, block)


def source_batches(items: DataFrame, order: list[str], size: str, max_items: int = 12, max_size: int = 24_000,
                   block: int = BLOCK) -> DataFrame:
    """Consecutive batches bounded by item count and summed size; ``items(document_id, ...)``."""
    rows = items.select("document_id", *order, F.col(size).cast("long").alias("size"))
    return _pack(rows, order, WINDOW_SCHEMA, max_items, max_size, 0, block)


def _pack(rows: DataFrame, order: list[str], schema: T.StructType, max_rows: int, max_size: int, overlap: int, block: int) -> DataFrame:
    def ends(cols: dict[str, list]):
        sizes = cols["size"]
        n = len(sizes)

        def end(s: int) -> tuple[int, int]:
            e, total = s, 0
            while e < n and e - s < max_rows and (e == s or total + sizes[e] <= max_size):
                total += sizes[e]
                e += 1
            return e, total
        return end, n

    def jumps(cols: dict[str, list], own: int):
        end, n = ends(cols)

        def nxt(s: int) -> int:
            e, _ = end(s)
            return n + own if e >= n else max(s + 1, e - overlap)
        return nxt

    def emit(cols: dict[str, list], own: int, entry: int, count: int):
        end, n = ends(cols)
        doc, first, s = cols["document_id"][0], cols["pos"][0], entry
        while s < own:
            e, total = end(s)
            count += 1
            yield doc, count, first + s, first + e - 1, total
            if e >= n:
                break
            s = max(s + 1, e - overlap)

    return blocked_scan(rows, ["document_id"], order, jump_summary(jumps, max_rows + 1), emit, schema, start=0, block=block, halo=max_rows)


def static_batches(chunks: DataFrame, size: int = 12, context: int = 6, fallback: int = 2) -> DataFrame:
    """Rows (document, batch, chunk, is_context): batches of ``size`` with one neighbour each side and shared context.

    Context chunks come from telling sections, at most ``context``, else the first ``fallback`` chunks.
    """
    rows = global_rank(chunks.select("document_id", "chunk_index", "chunk_id", "section_path"), ["document_id"],
                       [F.col("chunk_index"), F.col("chunk_id")], "pos")
    b = F.floor((F.col("pos") - 1) / size)
    inside = (F.col("pos") - 1) % size
    homes = F.array_compact(F.array(b, F.when((inside == 0) & (b > 0), b - 1), F.when(inside == size - 1, b + 1)))
    total = rows.groupBy("document_id").agg(F.max("pos").alias("_n"))
    last = F.floor((F.col("_n") - 1) / size)
    own = rows.select("document_id", "pos", "chunk_id", F.explode(homes).alias("batch_no")).join(total, "document_id").where(
        F.col("batch_no") <= last).select("document_id", "batch_no", "chunk_id", F.lit(False).alias("is_context"))
    w = W.partitionBy("document_id").orderBy("pos")
    telling = rows.where(contains_any("section_path", CONTEXT_SECTIONS)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= context)
    bare = rows.join(telling.select("document_id").distinct(), "document_id", "left_anti").where(F.col("pos") <= fallback)
    shared = telling.select("document_id", "chunk_id").unionByName(bare.select("document_id", "chunk_id"))
    batches = total.select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("batch_no"))
    ctx = batches.join(shared, "document_id").withColumn("is_context", F.lit(True))
    return own.unionByName(ctx).groupBy("document_id", "batch_no", "chunk_id").agg(F.max("is_context").alias("is_context"))
