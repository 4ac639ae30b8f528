"""Page triage, section roles, bundles, table audits, metadata backfill, discovery and review sheets."""

from __future__ import annotations

import re
from collections import namedtuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from litquarry.functions import pages as pg
from litquarry.functions.cells import canonical_digest, fold_cell, guard_formula, locate_quote, parse_measurement
from litquarry.functions.core import is_blank, nz, ratio
from litquarry.operators.relational import neighbours
from litquarry.operators.scan import blocked_scan
from litquarry.scale import global_rank, small_side

MAX_PAGES = 40
ROLE_PRIORITY = [("eligible", 110), ("method", 100), ("table", 90), ("compound_map", 80), ("abstract", 50), ("claims", 10)]


# ---- page triage ---------------------------------------------------------------------------------

def triage(pages: DataFrame) -> DataFrame:
    """Score, priority and selection of pages: ``document_id, page_number, text, eligible, method, result, table, claims``.

    Table pages pull in one neighbour each side, method pages two; a page that names at least two of the
    compound numbers seen in the document's tables and looks like a compound map is selected as well;
    at most 40 pages per document stay.
    """
    c = F.col
    p = pages.withColumn("abstract", pg.has("text", pg.ABSTRACT)).withColumn(
        "score", pg.page_score(c("text"), c("eligible"), c("method"), c("table"), c("claims")))
    key = ["document_id", "page_number"]
    near = neighbours(p.select(*key), p.where("table").select(*key), 1).unionByName(neighbours(p.select(*key), p.where("method").select(*key), 2))
    own = p.where(c("eligible") | c("method") | c("result") | (c("abstract") & (c("score") >= 6))).select(*key)
    ids = p.where("table").select("document_id", F.explode(pg.row_ids(c("text"))).alias("n")).distinct()
    numbers = p.where(~c("table") & pg.has("text", pg.COMPOUND_MAP)).select(*key, F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(r"\b(\d{1,5})\b"), F.lit(1)))).alias("n")).withColumn("n", c("n").cast("int"))
    maps = numbers.join(ids, ["document_id", "n"]).groupBy(*key).agg(F.count("*").alias("_hits")).where("_hits >= 2").select(*key)
    chosen = near.unionByName(own).unionByName(maps).distinct().withColumn("selected", F.lit(True))
    j = p.join(maps.withColumn("compound_map", F.lit(True)), key, "left").join(chosen, key, "left").na.fill(False, ["compound_map", "selected"])
    j = j.withColumn("score", c("score") + F.when(c("compound_map"), 8).otherwise(0))
    prio = None
    for role, value in ROLE_PRIORITY:
        prio = F.when(c(role), value) if prio is None else prio.when(c(role), value)
    return trim_pages(j.withColumn("priority", prio.otherwise(20)))


def trim_pages(pages: DataFrame, limit: int = MAX_PAGES) -> DataFrame:
    """Keep the best selected pages per document by role priority, score and page number."""
    w = W.partitionBy("document_id").orderBy(F.col("priority").desc(), F.col("score").desc(), "page_number")
    best = pages.where("selected").select("document_id", "page_number", F.row_number().over(w).alias("_n")).where(F.col("_n") <= limit).select(
        "document_id", "page_number", F.lit(True).alias("_keep"))
    return pages.join(best, ["document_id", "page_number"], "left").withColumn("selected", F.coalesce("_keep", F.lit(False))).drop("_keep")


# ---- section roles -------------------------------------------------------------------------------

# Patterns that open or mark a section.
SECTION_PATTERNS = {
    "claims": r"^(?:权利要求(?:书)?|Claims?\b|What is claimed\b)",
    "background": r"^(?:背景技术|技术背景|Background\b)",
    "disclosure": r"^(?:发明内容|发明概要|Summary\b)",
    "other": r"^(?:技术领域|具体实施方式|工业实用性|Detailed description\b|Industrial applicability\b|(?:Synthesis|Preparation|Formulation)\s+(?:example|of)\b)",
    "assay": r"^(?:(?:试验例|实验例)\s*\d*|(?:试验|实验)(?:方法|材料|设计|条件)|生物(?:活性)?测定|毒力测定|药效试验|TEST\s+[A-H]\b|Bioassay\b|(?:Biological|Fungicidal)\s+(?:tests?|examples?|assays?)\b)",
    "numbered": r"^(?:(?:试验例|实验例)\s*\d+|TEST\s+[A-H]\b)",
    "procedure": r"供试(?:菌株|病原|药剂)|接种|\binoculat\w*|\bincubat\w*|were\s+(?:treated|sprayed|measured)|disease ratings?",
    "result": r"^(?:\d+[、.：:]\s*)?(?:结果(?:及分析|与分析|[，,:：])|(?:试验|实验|测定)结果|Results?\b)|\bresults?\s+(?:are|were|shown|in)\b",
    "use": r"可(?:用于|防治|抑制)|\b(?:can|may)\s+(?:be used|control|inhibit)|\b(?:useful|suitable)\s+for\b",
    "caption": r"^(?:续\s*)?(?:表\s*\d+|Table\s+[\dIVX]+)",
}
ROLES = ["OTHER", "BACKGROUND", "CLAIMS", "CLAIMED_USE", "METHOD", "RESULT"]
ROLE_SCHEMA = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("role", T.StringType()),
                            T.StructField("assay_id", T.LongType())])


def section_roles(paragraphs: DataFrame, block: int = 4096) -> DataFrame:
    """Role, assay number and eligibility of each paragraph: ``document_id, page_number, paragraph, text``.

    Headings set a context that carries forward; a gap in page numbers resets it. Assays are numbered
    within the document. An assay is eligible when any of its paragraphs names a target organism and any
    reports activity, which is decided after the whole assay has been read.
    """
    c = F.col
    rows = global_rank(paragraphs.select("document_id", "page_number", "paragraph", "text"), ["document_id"], [c("page_number"), c("paragraph")], "pos")
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    marks = {k: F.rlike(t, F.lit("(?i)" + p)) for k, p in SECTION_PATTERNS.items()}
    prev = rows.select("document_id", (c("pos") + 1).alias("pos"), c("page_number").alias("_pp"))
    rows = rows.join(prev, ["document_id", "pos"], "left")
    kind = (F.when(t == "", "blank").when(marks["claims"], "claims").when(marks["background"], "background").when(marks["disclosure"], "disclosure")
            .when(marks["other"] & ~marks["assay"], "other").otherwise("text"))
    feed = rows.select("document_id", "pos", kind.alias("kind"), *[marks[k].alias(k) for k in ("assay", "numbered", "procedure", "result", "use", "caption")],
                       (c("_pp").isNotNull() & (c("page_number") > c("_pp") + 1)).alias("gap"))

    def step(state: int, r) -> tuple[int, int, int, int]:
        """State is context, assay open, phase; returns new state, role, assay opened, assay counted."""
        ctx, active, phase = state // 4, (state // 2) % 2, state % 2
        if r.gap:
            ctx, active = 0, 0
        opened, role = 0, ctx
        if r.kind in ("claims", "background", "disclosure", "other"):
            ctx = {"claims": 2, "background": 1, "disclosure": 3, "other": 0}[r.kind]
            active, role = 0, ctx
        elif r.kind == "blank":
            role = 0
        elif ctx in (1, 2):
            role = ctx
        elif r.use and not r.result and not r.assay:
            ctx, active, role = 3, 0, 3
        else:
            if r.numbered or (r.assay and phase == 1) or (not active and (r.assay or r.procedure)):
                active, phase, opened = 1, 0, 1
            if active and (r.result or r.caption):
                role, phase = 5, 1
            elif active:
                role = 4 if (r.procedure or r.assay) else 4 + phase
        return (ctx * 2 + active) * 2 + phase, role, opened, active

    def each(cols: dict[str, list]):
        own = {n: v for n, v in cols.items() if not n.startswith("_")}
        return map(namedtuple("Paragraph", own), *own.values())

    def summarise(cols: dict[str, list], own: int):
        states = {s: (s, 0) for s in range(16)}
        for r in each(cols):
            seen = {}
            for s in set(v[0] for v in states.values()):
                new, _, opened, _ = step(s, r)
                seen[s] = (new, opened)
            states = {s0: (seen[s][0], n + seen[s][1]) for s0, (s, n) in states.items()}
        for s0, (s, n) in states.items():
            yield s0, s, n

    def emit(cols: dict[str, list], own: int, state: int, count: int):
        for r in each(cols):
            state, role, opened, active = step(state, r)
            count += opened
            yield r.document_id, r.pos, ROLES[role], count if active and role >= 4 else 0

    roles = blocked_scan(feed, ["document_id"], ["pos"], summarise, emit, ROLE_SCHEMA, start=0, block=block)
    full = rows.select("document_id", "pos", "page_number", "paragraph", "text").join(roles, ["document_id", "pos"])
    facts = full.where("assay_id > 0").groupBy("document_id", "assay_id").agg(
        F.max(pg.has("text", pg.ORGANISM)).alias("_t"), F.max(pg.has("text", pg.ACTIVITY)).alias("_a")).where("_t AND _a").select(
        "document_id", "assay_id", F.lit(True).alias("eligible"))
    return full.join(facts, ["document_id", "assay_id"], "left").na.fill(False, ["eligible"])


# ---- bundles and table audits --------------------------------------------------------------------

def bundles(pages: DataFrame, tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """Outcome, status and missing parts per document with selected pages.

    ``pages(document_id, selected, method, result)``, ``tables(document_id)``, ``candidates(document_id, kind, selected_for_read)``.
    """
    c = F.col
    p = pages.groupBy("document_id").agg(F.count_if("selected").alias("pages"), F.count_if(c("selected") & c("method")).alias("methods"), F.count_if(c("selected") & c("result")).alias("results"))
    t = tables.groupBy("document_id").agg(F.count("*").alias("tables"))
    k = candidates.groupBy("document_id").agg(F.count_if("selected_for_read").alias("_read"), F.count_if(c("kind") == "ACTIVITY").alias("_act"))
    j = p.where("pages > 0").join(t, "document_id", "left").join(k, "document_id", "left").na.fill(0)
    bare = (c("tables") == 0) & (c("results") == 0)
    missing = F.array_compact(F.array(F.when(c("methods") == 0, "METHOD_CONTEXT"), F.when((c("tables") == 0) & (c("_read") > 0), "SELECTED_TABLE_NOT_RECOVERED"),
                                      F.when(bare, "RESULT_CONTEXT")))
    outcome = F.when((c("tables") == 0) & (c("_act") > 0), "UNRESOLVED").when(bare, "NO_EVIDENCE_FOUND").otherwise("EVIDENCE_FOUND")
    return j.select("document_id", "pages", "methods", "results", "tables", missing.alias("missing"), outcome.alias("outcome")).withColumn(
        "status", F.when(F.size("missing") == 0, "COMPLETE").otherwise("REVIEW_REQUIRED"))


def compare_reads(first: DataFrame, second: DataFrame) -> DataFrame:
    """VERIFIED when two independent readings of a table agree in every cell: ``table_id, row_no, col_no, text``."""
    key = ["table_id", "row_no", "col_no"]
    a, b = first.select(*key, F.col("text").alias("_a"), F.lit(1).alias("_ia")), second.select(*key, F.col("text").alias("_b"), F.lit(1).alias("_ib"))
    j = a.join(b, key, "full")
    differs = F.col("_ia").isNull() | F.col("_ib").isNull() | (fold_cell(F.col("_a")) != fold_cell(F.col("_b")))
    return j.groupBy("table_id").agg(F.count_if(differs).alias("differences"), F.count("*").alias("cells")).withColumn(
        "status", F.when(F.col("differences") == 0, "VERIFIED").otherwise("REVIEW_REQUIRED"))


def audit_rows(native: DataFrame, extracted: DataFrame) -> DataFrame:
    """Native table rows against extracted rows: MISSING, EXTRA, VALUE_MISMATCH, RATIO_MISMATCH or MATCH.

    Both: ``table_id, row_key, value, ratio``.
    """
    c = F.col
    k = ["table_id", "row_key"]
    side = lambda df, s: df.select("table_id", fold_cell(c("row_key")).alias("row_key"), parse_measurement("value").alias(f"_v{s}"), fold_cell(c("ratio")).alias(f"_r{s}"), F.lit(1).alias(f"_i{s}"))
    j = side(native, "n").join(side(extracted, "e"), k, "full")
    status = (F.when(c("_ie").isNull(), "MISSING").when(c("_in").isNull(), "EXTRA")
              .when(~c("_vn.value").eqNullSafe(c("_ve.value")) | (c("_vn.relation") != c("_ve.relation")), "VALUE_MISMATCH")
              .when(c("_rn") != c("_re"), "RATIO_MISMATCH").otherwise("MATCH"))
    return j.select(*k, status.alias("status"))


def resolve_legend(surfaces: DataFrame, chunks: DataFrame) -> DataFrame:
    """Full species name for abbreviations such as ``P. capsici`` from the document's own text; earliest chunk wins.

    ``surfaces(document_id, text)``, ``chunks(document_id, chunk_index, chunk_id, text)``.
    """
    pairs = lambda text, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(
        F.regexp_extract(m, pattern, 1).alias("g"), F.regexp_extract(m, pattern, 2).alias("species")))
    short = surfaces.select("document_id", F.explode(pairs("text", r"\b([A-Z])\.\s*([a-z][a-z-]{2,})\b")).alias("x")).select(
        "document_id", F.col("x.g").alias("initial"), "x.species").distinct()
    full = chunks.select("document_id", "chunk_index", "chunk_id", F.explode(pairs("text", r"\b([A-Z][a-z]+)\s+([a-z][a-z-]{2,})\b")).alias("x")).select(
        "document_id", "chunk_index", "chunk_id", F.col("x.g").alias("genus"), "x.species", F.substring("x.g", 1, 1).alias("initial"))
    return short.join(full, ["document_id", "initial", "species"]).groupBy("document_id", "initial", "species").agg(
        F.min_by(F.struct("genus", "chunk_id"), F.struct("chunk_index", "chunk_id")).alias("b")).select(
        "document_id", F.concat(F.col("initial"), F.lit(". "), F.col("species")).alias("code"), F.concat_ws(" ", "b.genus", "species").alias("meaning"), "b.chunk_id")


def explicit_legend(chunks: DataFrame) -> DataFrame:
    """``CODE = Genus species`` definitions; the earliest chunk defines a code."""
    p = r"\b([A-Z][A-Za-z]{0,4})\s*=\s*([A-Z][a-z]+\s+[a-z]+)"
    found = chunks.select("document_id", "chunk_index", "chunk_id", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m")).select(
        "document_id", "chunk_index", "chunk_id", F.regexp_extract("m", p, 1).alias("code"), F.regexp_extract("m", p, 2).alias("meaning"))
    return found.groupBy("document_id", "code").agg(F.min_by(F.struct("meaning", "chunk_id"), F.struct("chunk_index", "meaning")).alias("b")).select("document_id", "code", "b.*")


# ---- metadata ------------------------------------------------------------------------------------

def backfill(documents: DataFrame, sources: list[tuple[str, DataFrame]], fields: list[str]) -> DataFrame:
    """Fill only missing fields from lookup tables in priority order and say where each value came from."""
    j = documents
    for name, df in sources:
        j = j.join(df.select("document_id", *[F.col(f).alias(f"_{name}_{f}") for f in fields]), "document_id", "left")
    out = [F.col("document_id")]
    for f in fields:
        value, origin = nz(F.col(f).cast("string")), F.when(nz(F.col(f).cast("string")).isNotNull(), F.lit("existing"))
        for name, _ in sources:
            got = nz(F.col(f"_{name}_{f}").cast("string"))
            origin = F.coalesce(origin, F.when(got.isNotNull(), F.lit(name)))
            value = F.coalesce(value, got)
        out += [value.alias(f), origin.alias(f"{f}_source")]
    return j.select(*out)


def backfill_counters(filled: DataFrame, field: str) -> DataFrame:
    return filled.groupBy(F.coalesce(f"{field}_source", F.lit("missing")).alias("source")).agg(F.count("*").alias("documents"))


# ---- discovery and review ------------------------------------------------------------------------

def check_extractions(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """Status per extracted question after locating its quote: ``document_id, question_no, question, quote`` against ``text``."""
    loc = locate_quote(F.col("text"), F.col("quote"))
    j = extractions.join(documents.select("document_id", "text"), "document_id").withColumn("loc", loc)
    first = j.groupBy("document_id", F.lower("question").alias("_q")).agg(F.min("question_no").alias("_first"))
    out = j.withColumn("_q", F.lower("question")).join(first, ["document_id", "_q"])
    status = F.when(is_blank("question"), "EMPTY_QUESTION").when(F.col("question_no") != F.col("_first"), "DUPLICATE_QUESTION").otherwise(F.col("loc.status"))
    return out.select("document_id", "question_no", status.alias("status"), F.when(status == "OK", F.col("loc.start_offset")).alias("start_offset"))


def embedding_status(members: DataFrame) -> DataFrame:
    """Document status from its members' embeddings: ``document_id, member_id, failed``."""
    a = members.groupBy("document_id").agg(F.count_if("failed").alias("_f"), F.count("*").alias("members"))
    return a.select("document_id", "members", F.when(F.col("_f") == 0, "READY").when(F.col("_f") == F.col("members"), "EMBEDDING_FAILED").otherwise("PARTIAL_EMBEDDING").alias("status"))


def cluster_status(members: DataFrame, parts: DataFrame, represented: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status per cluster from its summary parts, and members that no common question cites.

    ``members(cluster, member_id)``, ``parts(cluster, part_no, status)``, ``represented(cluster, member_id)``.
    """
    c = F.col
    n = members.groupBy("cluster").agg(F.count("*").alias("members"))
    p = parts.groupBy("cluster").agg(F.count("*").alias("_parts"), F.count_if(c("status") == "FAILED").alias("_failed"), F.count_if(c("status") == "NEEDS_SPLIT").alias("_split"))
    r = represented.groupBy("cluster").agg(F.count("*").alias("_rep"))
    j = n.join(p, "cluster", "left").join(r, "cluster", "left").na.fill(0)
    status = (F.when((c("_failed") > 0) & (c("_rep") > 0), "PARTIAL").when(c("_failed") > 0, "FAILED").when((c("_parts") > 1) | (c("_split") > 0), "NEEDS_SPLIT")
              .when(c("members") == 1, "SINGLETON").otherwise("READY"))
    return j.select("cluster", "members", status.alias("status")), members.join(represented, ["cluster", "member_id"], "left_anti")


FIXED = ["kind", "mode", "document_id", "item_id", "status", "text"]


def review_sheet(items: DataFrame) -> DataFrame:
    """Rows for human review with an id made from their guarded fixed fields."""
    guarded = items.select(*[guard_formula(F.col(f).cast("string")).alias(f) for f in FIXED])
    return guarded.withColumn("row_id", canonical_digest(**{f: F.col(f) for f in FIXED}))


def merge_review(expected: DataFrame, previous: DataFrame, answers: list[str]) -> tuple[DataFrame, DataFrame]:
    """New sheet with earlier answers where the fixed fields are unchanged, and rows that were tampered with."""
    old = previous.select("row_id", *[F.col(f).alias(f"_{f}") for f in FIXED], *answers)
    j = expected.join(old, "row_id", "left")
    same = F.lit(True)
    for f in FIXED:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    kept = j.select("row_id", *FIXED, *[F.when(same, F.col(a)).alias(a) for a in answers])
    unknown = previous.join(expected, "row_id", "left_anti").select("row_id", F.lit("UNKNOWN_ROW").alias("reason"))
    changed = j.where(F.col("_kind").isNotNull() & ~same).select("row_id", F.lit("FIXED_FIELD_CHANGED").alias("reason"))
    return kept, unknown.unionByName(changed)


def review_rates(rows: DataFrame, by: list[str], field: str, positive: list[str]) -> DataFrame:
    """Share of positive answers; the value is null until nothing is pending, the subset value counts judged rows."""
    c = F.col
    a = F.lower(nz(field))
    r = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count(a).alias("reviewed"), F.count_if(a.isin(positive)).alias("correct"))
    r = r.withColumn("pending", c("total") - c("reviewed"))
    return r.withColumn("value", F.when((c("pending") == 0) & (c("total") > 0), ratio(c("correct"), c("total")))).withColumn(
        "reviewed_subset_value", F.when(c("reviewed") > 0, ratio(c("correct"), c("reviewed"))))


def review_coverage(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Covered over known reference questions per mode: ``mode, document_id, covered`` and ``document_id, questions``."""
    c = F.col
    j = rows.join(reference, "document_id", "left")
    known = c("questions").isNotNull()
    done = known & (c("covered").isNotNull() | (c("questions") == 0))
    r = j.groupBy("mode").agg(F.count("*").alias("total_documents"), F.sum(F.coalesce("questions", F.lit(0))).alias("known_reference_questions"),
                              F.sum(F.when(known, F.coalesce("covered", F.lit(0))).otherwise(0)).alias("covered"), F.count_if(done).alias("reviewed_documents"))
    return r.withColumn("value", F.when((c("reviewed_documents") == c("total_documents")) & (c("known_reference_questions") > 0),
                                        ratio(c("covered"), c("known_reference_questions"))))


def rate_delta(rates: DataFrame, mode: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """Difference of complete values between two modes."""
    wide = rates.groupBy(*keys).pivot(mode, [a, b]).agg(F.max("value"))
    return wide.withColumn("b_minus_a", F.col(b) - F.col(a)).select(*keys, "b_minus_a")
