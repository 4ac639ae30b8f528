"""Deduplication, quality gate, screening decision and cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from litquarry.functions.core import fold_space_ascii, is_blank, nz, ratio, round_half_up
from litquarry.scale import cut, join_known

MIN_CHUNKS, MIN_CHARS = 3, 1500
MAX_REPLACED, MAX_SHORT_LINES = 0.03, 0.80
SHORT_LINE = 20
COHORT_BLOCK = 10_000


# ---- order-dependent dedup -----------------------------------------------------------------------

def greedy_canonical(rows: DataFrame, order: str, keys: list[str], max_rounds: int = 10_000) -> DataFrame:
    """Rows that a scan in ``order`` would keep, when only kept rows register their keys.

    ``order`` is unique; null keys match nothing. A row whose every key has no earlier
    undecided holder is kept, and then every later row sharing a key with it is dropped,
    because a kept row always holds the smallest order of its keys. Rounds repeat on the
    rest, which shrinks fast; only per-key minima are shuffled, never pairs.
    """
    undecided = cut(rows.select(order, *keys))
    kept: list[DataFrame] = []
    for _ in range(max_rounds):
        first = undecided
        for k in keys:
            low = undecided.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_min_{k}"))
            first = join_known(first, low, k, "left")
        free = reduce(lambda a, b: a & b, [F.col(f"_min_{k}").isNull() | (F.col(f"_min_{k}") == F.col(order)) for k in keys])
        marked = cut(first.withColumn("_keep", free).select(order, *keys, "_keep"))
        keep = marked.where("_keep").drop("_keep")
        kept.append(keep)
        rest = marked.where(~F.col("_keep")).drop("_keep")
        for k in keys:
            rest = join_known(rest, keep.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        undecided = cut(rest.select(order, *keys))
        if undecided.isEmpty():
            return reduce(DataFrame.unionByName, kept)
    raise RuntimeError(f"dedup did not settle within {max_rounds} rounds")


def dedup(docs: DataFrame) -> DataFrame:
    """Canonical documents by DOI, else by content hash; earliest wins, the others point at it.

    ``docs(document_id, doi, sha)``; arrival order is ``document_id``.
    """
    base = docs.select("document_id", nz("doi").alias("doi"), "sha")
    canon = greedy_canonical(base, "document_id", ["doi", "sha"])
    by_doi = canon.where(F.col("doi").isNotNull()).select("doi", F.col("document_id").alias("_doi_id"))
    by_sha = canon.where(F.col("sha").isNotNull()).select("sha", F.col("document_id").alias("_sha_id"))
    j = join_known(join_known(base, by_doi, "doi", "left"), by_sha, "sha", "left")
    me = F.col("document_id")
    by_d = F.when(F.col("_doi_id") < me, F.col("_doi_id"))
    by_s = F.when(F.col("_sha_id") < me, F.col("_sha_id"))
    kept = (F.col("_doi_id") == me) | (F.col("_sha_id") == me)
    dup = F.when(F.coalesce(kept, F.lit(False)), F.lit(None).cast("long")).otherwise(F.coalesce(by_d, by_s))
    reason = F.when(dup.isNull(), F.lit(None)).when(by_d.isNotNull(), "DOI").otherwise("CONTENT_SHA256")
    key = F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), F.col("doi"))).otherwise(
        F.concat(F.lit("sha256:"), F.col("sha")))
    return j.select("document_id", key.alias("own_key"), dup.alias("duplicate_of"), reason.alias("reason"))


def text_key(title: Column, abstract: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lower(F.trim(title)), F.lower(fold_space_ascii(abstract))), 256)


def prepare_corpus(records: DataFrame) -> DataFrame:
    """Status per record: READY, DUPLICATE_ID, DUPLICATE, an input error or MISSING_ABSTRACT.

    ``records(document_id, line_no, title, abstract, doi, declared_duplicate_of, input_error)``;
    scan order is (document_id, line_no) and only READY rows register id, DOI and text.
    """
    r = records.select(
        "*", F.struct("document_id", "line_no").alias("_ord"), nz("doi").alias("_doi"),
        text_key(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("_text"))
    able = nz("declared_duplicate_of").isNull() & nz("input_error").isNull() & ~is_blank("abstract")
    ready = greedy_canonical(
        r.where(able).select("_ord", F.col("document_id").alias("_id"), "_doi", "_text"), "_ord", ["_id", "_doi", "_text"])
    by = lambda k, name: ready.where(F.col(k).isNotNull()).select(
        F.col(k).alias(f"_k{name}"), F.col("_ord").alias(f"_o{name}"), F.col("_id").alias(f"_i{name}"))
    j = (r.join(by("_id", "a"), F.col("document_id") == F.col("_ka"), "left")
         .join(by("_doi", "b"), F.col("_doi") == F.col("_kb"), "left")
         .join(by("_text", "c"), F.col("_text") == F.col("_kc"), "left"))
    earlier = lambda n: F.col(f"_o{n}") < F.col("_ord")
    dup_of = F.coalesce(nz("declared_duplicate_of"), F.when(earlier("b"), F.col("_ib")).cast("string"),
                        F.when(earlier("c"), F.col("_ic")).cast("string"))
    status = (F.when(earlier("a"), "DUPLICATE_ID").when(dup_of.isNotNull(), "DUPLICATE")
              .when(nz("input_error").isNotNull(), F.col("input_error")).when(is_blank("abstract"), "MISSING_ABSTRACT")
              .otherwise("READY"))
    return j.select("document_id", "line_no", status.alias("status"),
                    F.when(status == "DUPLICATE", dup_of).alias("duplicate_of"), F.col("_text").alias("content_hash"))


def seeded_selection(prepared: DataFrame, limit: int, order: Column) -> DataFrame:
    """READY rows become SELECTED or NOT_SELECTED; at most ``limit`` are selected, by a seeded order."""
    if limit == 0:
        return prepared.withColumn("status", F.when(F.col("status") == "READY", "SELECTED").otherwise(F.col("status")))
    chosen = prepared.where("status = 'READY'").withColumn("_o", order).orderBy("_o", "document_id").limit(limit)
    picked = chosen.select("document_id", "line_no", F.lit(True).alias("_picked"))
    new = F.when(F.col("status") != "READY", F.col("status")).when(F.col("_picked"), "SELECTED").otherwise("NOT_SELECTED")
    return prepared.join(picked, ["document_id", "line_no"], "left").withColumn("status", new).drop("_picked")


def exclusion_counts(prepared: DataFrame) -> DataFrame:
    return prepared.where("status NOT IN ('READY', 'SELECTED')").groupBy("status").agg(F.count("*").alias("n"))


# ---- quality and screening -----------------------------------------------------------------------

def text_quality(chunks: DataFrame, replacement_chars: str = "�?") -> DataFrame:
    """Chunk, character, garble and short-line measures per document from ``chunks(document_id, text)``."""
    text = F.col("text")
    full = ~F.coalesce(F.rlike(text, F.lit(r"^\s*$")), F.lit(True))
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\x0B\f\r\x85  ]"), lambda x: F.regexp_replace(
        x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), lambda x: x != "")
    per_chunk = chunks.select(
        "document_id", F.when(full, F.length(text)).otherwise(0).alias("chars"),
        F.when(full, F.length(text) - F.length(F.translate(text, replacement_chars, ""))).otherwise(0).alias("bad"),
        F.when(full, F.size(lines)).otherwise(0).alias("lines"),
        F.when(full, F.size(F.filter(lines, lambda x: F.length(x) < SHORT_LINE))).otherwise(0).alias("short"))
    s = per_chunk.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.sum("chars").alias("total_chars"), F.sum("bad").alias("_bad"),
        F.sum("lines").alias("_lines"), F.sum("short").alias("_short"))
    c = F.col
    return s.select("document_id", "chunk_count", "total_chars", ratio(c("total_chars"), c("chunk_count")).alias("average_chunk_chars"),
                    ratio(c("_bad"), c("total_chars")).alias("replacement_ratio"),
                    ratio(c("_short"), c("_lines")).alias("short_line_ratio"))


def quality_gate(docs: DataFrame, quality: DataFrame) -> DataFrame:
    """Decision, status and first failing reason; ``docs(document_id, title, abstract)``."""
    j = docs.join(quality, "document_id", "left").na.fill(
        {"chunk_count": 0, "total_chars": 0, "replacement_ratio": 0.0, "short_line_ratio": 0.0, "average_chunk_chars": 0.0})
    c = F.col
    fails = (F.when(c("chunk_count") < MIN_CHUNKS, "LOW_CHUNK_COUNT").when(c("total_chars") < MIN_CHARS, "LOW_TEXT_COVERAGE")
             .when(c("replacement_ratio") > MAX_REPLACED, "HIGH_GARBLED_TEXT_RATIO")
             .when(c("short_line_ratio") > MAX_SHORT_LINES, "HIGH_SHORT_LINE_RATIO"))
    usable = ~is_blank("title") | ~is_blank("abstract") | (c("total_chars") > 0)
    status = F.when(fails.isNull(), "FULL_TEXT_READY").when(usable, "METADATA_READY").otherwise("UNUSABLE")
    return j.select(
        "*", F.when(fails.isNull(), "PASS").otherwise("REJECT").alias("quality_decision"), status.alias("quality_status"),
        F.when(fails.isNull(), "").when(usable, fails).otherwise("MISSING_USABLE_CONTENT").alias("quality_reason"))


def screening(gated: DataFrame, labels: DataFrame) -> DataFrame:
    """Final decision per document from quality status, available metadata and a relevance label.

    ``gated`` comes from :func:`quality_gate`; ``labels(document_id, screening_label)``.
    """
    j = gated.join(labels, "document_id", "left")
    c = F.col
    label = F.coalesce("screening_label", F.lit("NOT_RUN"))
    unusable, no_abstract = c("quality_status") == "UNUSABLE", is_blank("abstract")
    source = (F.when(unusable, "NO_METADATA").when(no_abstract, "TITLE_ONLY").when(is_blank("title"), "ABSTRACT_ONLY")
              .otherwise("TITLE_AND_ABSTRACT"))
    relevance = (F.when(unusable, "NOT_EVALUATED").when(no_abstract, "POTENTIALLY_RELEVANT")
                 .when(label == "RELEVANT", "RELEVANT")
                 .when(label.isin("NOT_RUN", "POTENTIALLY_RELEVANT") | (source != "TITLE_AND_ABSTRACT"), "POTENTIALLY_RELEVANT")
                 .otherwise("NOT_RELEVANT"))
    j = j.withColumn("relevance_source", source).withColumn("relevance", relevance)
    final = (F.when(c("quality_status") == "UNUSABLE", "SKIPPED").when(c("relevance") == "NOT_RELEVANT", "REJECTED")
             .otherwise("ACCEPTED"))
    j = j.withColumn("final_decision", final)
    return j.withColumn("reject_reason", F.when(c("final_decision") == "REJECTED", "LABEL_NOT_RELEVANT").otherwise(""))


def screening_cohorts(screened: DataFrame) -> DataFrame:
    """Long (cohort, document_id) membership of the four published cohorts."""
    c = F.col
    accepted = c("final_decision") == "ACCEPTED"
    names = F.filter(F.array(
        F.when(accepted, F.lit("accepted")), F.when(c("final_decision") == "REJECTED", F.lit("rejected")),
        F.when(accepted & c("relevance_source").isin("TITLE_AND_ABSTRACT", "ABSTRACT_ONLY"), F.lit("abstract-analysis")),
        F.when(accepted & (c("quality_status") == "FULL_TEXT_READY"), F.lit("full-text-evidence"))), lambda x: x.isNotNull())
    return screened.select("document_id", F.explode(names).alias("cohort"))


# ---- keyed tables and cohorts --------------------------------------------------------------------

def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins per key; ``delta`` rows beat ``base`` and the highest ``order`` beats the rest."""
    cols = base.columns
    latest = delta.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*")
    return base.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert only keys that ``base`` lacks; the lowest ``order`` of ``delta`` is inserted."""
    first = delta.groupBy(*keys).agg(F.min_by(F.struct(*base.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return base.unionByName(first.join(base.select(*keys), keys, "left_anti"))


def replace_cohorts(members: DataFrame, published: DataFrame) -> DataFrame:
    """Published cohorts replace the member list of the same name."""
    names = published.select("cohort").distinct()
    return members.join(names, "cohort", "left_anti").unionByName(published.select(*members.columns))


def cohort_hash(members: DataFrame, block: int = COHORT_BLOCK) -> DataFrame:
    """Hash tree of each cohort's ids, newline-joined in ordinal order, at every size the same.

    ``members(cohort, ordinal, document_id)`` with ordinals from 1. Ids are hashed (SHA-256) in blocks of ``block``,
    and the hashes of blocks again, level by level and at least once, until one is left. No task holds a whole cohort.
    """
    level = members.select("cohort", F.col("ordinal").cast("long").alias("n"), F.col("document_id").cast("string").alias("v"))
    largest = members.agg(F.max("ordinal")).first()[0] or 0
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), "\n")
    levels = 0
    while levels < 2 or largest > 1:
        blocks = level.groupBy("cohort", (F.floor((F.col("n") - 1) / block) + 1).alias("n"))
        # from the third level on a cohort of one entry has its hash already
        value = F.sha2(joined, 256) if levels < 2 else F.when(F.count("*") == 1, F.max("v")).otherwise(F.sha2(joined, 256))
        level = blocks.agg(value.alias("v"))
        levels, largest = levels + 1, -(-largest // block)
    return level.select("cohort", F.col("v").alias("input_hash"))
