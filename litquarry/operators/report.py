"""Evidence report: what is reportable, how it ranks, what it adds up to and what represents it."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from litquarry.functions import pages as pg
from litquarry.functions.core import first_non_blank, nz, ratio, round_half_up
from litquarry.scale import cut, exact_median, global_rank

SAMPLES = 5
UNSPECIFIED = "unspecified"
# Field weights of the evidence score and of the document score.
FIELD_WEIGHTS = {"compound_name": 5, "standard_name": 5, "organism": 4, "assay_method": 3, "mechanism": 3, "activity_data": 2,
                 "structure_type": 2, "source_category": 2, "source_description": 1, "document_title": 1}
METRIC = r"(?i)\b(EC50|IC50|MIC|MFC)\b|抑制率|防效"
UNIT = r"(?i)(μg/mL|ug/mL|mg/L|g/L|ng/mL|μM|uM|mM|mol/L|mmol/g|g/ha|mg/kg|%)"
LONG_WORD, MIDDLE_WORD = 8, 5
ASCII_TERM = r"[A-Za-z][A-Za-z0-9\-]{2,}"


# ---- selection of rows ---------------------------------------------------------------------------

def reportable(evidence: DataFrame) -> DataFrame:
    """Current, valid rows that are pending or approved."""
    return evidence.where(F.col("is_current") & (F.col("validation_status") == "VALID")
                          & F.col("review_status").isin("PENDING", "APPROVED"))


def reportable_order() -> list[Column]:
    c = F.col
    return [F.when(c("review_status") == "APPROVED", 0).otherwise(1), c("model_confidence").desc_nulls_last(),
            c("updated_at").desc(), c("evidence_id")]


def reportable_ordered(evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Reportable rows, approved and confident first: all of them, or the first ``limit``."""
    ordered = reportable(evidence).orderBy(*reportable_order())
    return ordered if limit is None else ordered.limit(max(limit, 1))


def rank_reportable(evidence: DataFrame) -> DataFrame:
    """Position of every row in report order, ranked on narrow keys over all tasks."""
    narrow = evidence.select("evidence_id", "review_status", "model_confidence", "updated_at")
    return global_rank(narrow, [], reportable_order(), "rank")


def compound_key() -> Column:
    return F.lower(F.coalesce(nz("compound_name"), F.lit("unknown")))


def query_weights(terms: list[str]) -> Column:
    """Weighted count of terms in ``text``: long words count 4, middle ones 2, short ones 1."""
    score = F.lit(0)
    for t in terms:
        weight = 4 if len(t) >= LONG_WORD else 2 if len(t) >= MIDDLE_WORD else 1
        score = score + F.when(F.contains(F.col("text"), F.lit(t)), weight).otherwise(0)
    return score


def lexical_terms(text: Column, stop: list[str]) -> Column:
    """Distinct query terms; Latin terms are cut out of mixed text as well as kept inside longer runs."""
    low = F.lower(text)
    ascii_terms = F.regexp_extract_all(low, F.lit(ASCII_TERM), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}\-]{2,}"), F.lit(0))
    return F.filter(F.array_distinct(F.concat(ascii_terms, runs)), lambda t: (F.length(t) >= 3) & ~t.isin(stop))


def lexical_search(evidence: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """Rows that contain any term, with their score; ``terms`` come from one prompt."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return evidence.withColumn("text", text).withColumn("score", query_weights(terms)).where("score > 0").drop("text")


def fielded_score(evidence: DataFrame, terms: list[str]) -> DataFrame:
    """Sum of field weights over terms, plus review status and confidence once anything matched."""
    score = F.lit(0.0)
    for term in terms:
        for field, weight in FIELD_WEIGHTS.items():
            if field in evidence.columns:
                score = score + F.when(F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(term.lower())), float(weight)).otherwise(0.0)
    bonus = F.when(F.col("review_status") == "APPROVED", 0.4).otherwise(0.2) + F.coalesce(F.col("model_confidence") * 0.2, F.lit(0.0))
    scored = evidence.withColumn("match_score", score)
    scored = scored.withColumn("match_score", round_half_up(F.when(F.col("match_score") > 0, F.col("match_score") + bonus).otherwise(0.0), 6))
    return scored.where("match_score > 0") if terms else scored


def rank_evidence(evidence: DataFrame, terms: list[str]) -> DataFrame:
    """Fielded score and position of every match; ranking moves only ids and scores."""
    scored = fielded_score(evidence, terms)
    return global_rank(scored.select("evidence_id", "match_score"), [], [F.col("match_score").desc(), F.col("evidence_id").asc()], "rank")


def conflict_key() -> Column:
    fold = lambda f: F.lower(F.trim(F.coalesce(f, F.lit(""))))
    return F.concat_ws("|", fold("compound_name"), fold("organism"), fold("assay_method"))


def conflicts(evidence: DataFrame) -> DataFrame:
    """Conflict group of each row whose (compound, organism, assay) reports different activities."""
    keyed = evidence.withColumn("_key", conflict_key())
    groups = keyed.groupBy("_key").agg(F.countDistinct(F.lower(F.trim(F.coalesce("activity_data", F.lit(""))))).alias("_n")).where("_n > 1")
    return keyed.join(groups, "_key", "left").withColumn(
        "conflict_group", F.when(F.col("_n").isNotNull(), F.concat(F.lit("conflict-"), F.substring(F.sha2("_key", 256), 1, 16)))).drop("_key", "_n")


# ---- aggregates ----------------------------------------------------------------------------------

FACETS = ["source_category", "structure_type", "assay_method", "organism"]


def facet_counts(evidence: DataFrame) -> DataFrame:
    """Counts of four facets from one scan; blanks are counted as unspecified."""
    named = evidence.select(*[F.coalesce(nz(f), F.lit(UNSPECIFIED)).alias(f) for f in FACETS])
    cols = [F.col(f) for f in FACETS]
    g = named.groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("n"), F.grouping_id(*FACETS).alias("_g"))
    facet, value = F.lit(None), F.lit(None)
    for i, f in enumerate(FACETS):
        mask = (2 ** len(FACETS) - 1) & ~(1 << (len(FACETS) - 1 - i))
        facet = F.when(F.col("_g") == mask, f).otherwise(facet)
        value = F.when(F.col("_g") == mask, F.col(f)).otherwise(value)
    return g.select(facet.alias("facet"), value.alias("value"), "n")


def first_samples(evidence: DataFrame, key: Column, value: Column, order: str, limit: int = SAMPLES) -> DataFrame:
    """First distinct non-blank values per key in evidence order, joined; only ``limit`` reach one row."""
    once = evidence.select(key.alias("key"), nz(value).alias("v"), order).where("v IS NOT NULL").groupBy("key", "v").agg(F.min(order).alias("o"))
    w = W.partitionBy("key").orderBy("o", "v")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("samples"))


def compound_rollup(evidence: DataFrame, reference_order: bool = False) -> DataFrame:
    """Rows, distinct documents, organisms and structures per compound, with activity samples and position.

    Ordered by documents, rows (both falling) and name; ``reference_order`` sorts documents rising.
    """
    key = compound_key()
    e = evidence.withColumn("key", key)
    agg = e.groupBy("key").agg(
        F.min_by("compound_name", "evidence_id").alias("display_name"), F.min_by("name_kind", "evidence_id").alias("name_kind"),
        F.count("*").alias("evidence_rows"), F.countDistinct("document_id").alias("documents"),
        F.countDistinct(nz("organism")).alias("organisms"), F.countDistinct(nz("structure_type")).alias("structures"))
    agg = agg.join(first_samples(e, F.col("key"), F.col("activity_data"), "evidence_id"), "key", "left")
    docs = F.col("documents").asc() if reference_order else F.col("documents").desc()
    return global_rank(agg, [], [docs, F.col("evidence_rows").desc(), F.col("display_name").asc(), F.col("key").asc()], "position")


def overview(evidence: DataFrame) -> DataFrame:
    """One row: rows, compounds, documents, organisms, and compounds per name kind."""
    per_key = evidence.groupBy(compound_key().alias("key")).agg(F.min_by("name_kind", "evidence_id").alias("kind"))
    kinds = per_key.agg(F.count("*").alias("compounds"), *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("PURE", "EXTRACT", "LOCAL")])
    base = evidence.agg(F.count("*").alias("evidence_rows"), F.countDistinct("document_id").alias("documents"),
                        F.countDistinct(nz("organism")).alias("organisms"), F.count_if(F.col("review_status") == "PENDING").alias("pending"),
                        F.count_if(F.col("review_status") == "APPROVED").alias("approved"))
    return base.join(F.broadcast(kinds), F.lit(True))  # one row each


def supplementary(evidence: DataFrame, fields: list[str], order: str = "evidence_id") -> DataFrame:
    """Non-blank counts and first distinct samples of optional fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), nz(f).alias("value")) for f in fields])).alias("x")
    long = evidence.select(order, pairs).select(order, "x.field", "x.value").where("value IS NOT NULL")
    return long.groupBy("field").agg(F.count("*").alias("n")).join(
        first_samples(long, F.col("field"), F.col("value"), order).withColumnRenamed("key", "field"), "field", "left")


def common_compounds(evidence: DataFrame) -> DataFrame:
    """Compounds by distinct documents, approved rows, rows and name."""
    named = evidence.where(nz("compound_name").isNotNull())
    agg = named.groupBy(F.lower(F.trim("compound_name")).alias("key")).agg(
        F.min_by("compound_name", "evidence_id").alias("name"), F.countDistinct("document_id").alias("documents"),
        F.count_if(F.col("review_status") == "APPROVED").alias("approved"), F.count("*").alias("evidence_rows"),
        F.countDistinct(F.lower(nz("organism"))).alias("organisms"))
    return global_rank(agg, [], [F.col("documents").desc(), F.col("approved").desc(), F.col("evidence_rows").desc(), F.col("name").asc()], "position")


def document_scores(evidence: DataFrame, eligible: DataFrame, limit: int = 15) -> DataFrame:
    """Best documents by summed evidence value among eligible ones (``document_id``)."""
    c = F.col
    row = (1 + F.greatest(F.lit(0.0), c("match_score")) + F.when(c("review_status") == "APPROVED", 3).otherwise(0)
           + F.when(nz("mechanism").isNotNull(), 1).otherwise(0) + F.when(pg.is_application("application"), 1).otherwise(0))
    agg = evidence.groupBy("document_id").agg(F.sum(row).alias("_s"), F.count("*").alias("evidence_rows"),
                                              F.countDistinct(F.lower(F.trim("compound_name"))).alias("compounds"))
    scored = agg.withColumn("score", round_half_up(c("_s") + 2.0 * c("compounds"), 6)).drop("_s").join(
        eligible.select("document_id").distinct(), "document_id", "left_semi")
    return scored.orderBy(c("score").desc(), c("document_id").cast("string")).limit(limit)


def section_coverage(evidence: DataFrame) -> DataFrame:
    """Rows that support each report section and whether the section is short of evidence.

    ``evidence`` has the report fields, ``conflict_group`` included.
    """
    any_of = lambda *f: F.coalesce(*[nz(x) for x in f]).isNotNull()
    tests = {"background": F.lit(False), "classes": any_of("source_category", "structure_type"), "activity": any_of("activity_data"),
             "mechanisms": any_of("mechanism"), "applications": pg.is_application("application"),
             "safety": any_of("cytotoxicity", "resistance"), "conflicts": F.col("conflict_group").isNotNull()}
    one = evidence.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.col(k).alias("n")) for k in tests])).alias("x")).select("x.*")
    floor = F.when(F.col("section").isin("mechanisms", "applications"), 3).otherwise(1)
    return long.withColumn("missing", F.col("n") < floor)


def comparable_groups(evidence: DataFrame) -> DataFrame:
    """(organism, assay, metric, unit) groups with at least two rows; members stay rows of the evidence table."""
    a = F.coalesce("activity_data", F.lit(""))
    fold = lambda f: F.lower(F.trim(F.coalesce(f, F.lit(""))))
    e = evidence.select(fold("organism").alias("organism"), fold("assay_method").alias("assay_method"), F.lower(F.regexp_extract(a, METRIC, 0)).alias("metric"),
                        F.lower(F.regexp_extract(a, UNIT, 0)).alias("unit"), "evidence_id").where("metric <> '' AND unit <> ''")
    return e.groupBy("organism", "assay_method", "metric", "unit").agg(F.countDistinct("evidence_id").alias("members")).where("members >= 2")


def coverage_hint(matches: DataFrame, min_rows: int = 6, min_compounds: int = 4) -> DataFrame:
    """One row with distinct compounds and organisms; null when the matches are too few to summarise."""
    a = matches.agg(F.count("*").alias("n"), F.countDistinct(F.lower(nz("compound_name"))).alias("compounds"),
                    F.countDistinct(F.lower(nz("organism"))).alias("organisms"))
    enough = (F.col("n") >= min_rows) & (F.col("compounds") >= min_compounds)
    return a.select("n", F.when(enough, F.col("compounds")).alias("compounds"), F.when(enough, F.col("organisms")).alias("organisms"))


def potency(observations: DataFrame) -> DataFrame:
    """Exact median lower bound per material; right-censored values count at their bound.

    ``observations(material_id, relation, value)``.
    """
    used = observations.where("relation = 'GT' OR value IS NOT NULL").withColumn(
        "value", F.when(F.col("relation") == "GT", F.coalesce("value", F.lit(50.0))).otherwise(F.col("value")))
    stats = used.groupBy("material_id").agg(F.count_if(F.col("relation") == "GT").alias("censored"), F.count("*").alias("tested"))
    med = exact_median(used, ["material_id"], "value", "median_lower_bound")
    return stats.join(med, "material_id").withColumn("median_lower_bound", round_half_up("median_lower_bound", 2))


# ---- selections ----------------------------------------------------------------------------------

STEP_ROWS = 1000  # rows that one step of a pick reads


def diverse_selection(scored: DataFrame, max_rows: int = 90, max_compounds: int = 50, per_compound: int = 3,
                      compounds_per_document: int = 5) -> DataFrame:
    """Score-ordered pick that bounds rows per compound and new compounds per document, over all rows.

    Whether a row may be picked depends on the picks before it, so the pick goes in steps. Spark filters all rows
    behind the last one read to those that the picks so far allow and returns the first STEP_ROWS of them; the first
    of these is always picked, so there are at most ``max_rows`` steps however many rows a compound has.
    """
    c = F.col
    when = F.unix_micros(c("updated_at").cast("timestamp"))
    place = F.struct(c("score").isNull(), -F.coalesce(c("score").cast("double"), F.lit(0.0)), when.isNull(), -F.coalesce(when, F.lit(0)), c("evidence_id").cast("string"))
    rows = scored.select("evidence_id", compound_key().alias("k"), "document_id", place.alias("place"))
    taken: dict[str, int] = {}
    opened: dict = {}
    picks: list = []
    last = None
    while len(picks) < max_rows:
        full = [k for k, n in taken.items() if n == per_compound]
        closed = [d for d, ks in opened.items() if len(ks) == compounds_per_document and d is not None]
        known = c("k").isin([k for k in taken if k not in full])
        fresh = F.lit(False) if len(taken) == max_compounds else ~c("k").isin(list(taken)) & ~F.coalesce(c("document_id").isin(closed), F.lit(False))
        left = rows.where(known | fresh)
        if last is not None:
            left = left.where(c("place") > F.struct(*map(F.lit, last)))
        step = left.orderBy("place").limit(STEP_ROWS).collect()
        for r in step:
            have, here = taken.get(r.k, 0), opened.setdefault(r.document_id, set())
            first_of_k = have == 0 and len(taken) < max_compounds and len(here) < compounds_per_document
            if len(picks) < max_rows and (0 < have < per_compound or first_of_k):
                taken[r.k] = have + 1
                here.update([r.k] if first_of_k else [])
                picks.append((r.evidence_id, len(picks) + 1))
        if len(step) < STEP_ROWS:
            break
        last = step[-1].place
    return scored.sparkSession.createDataFrame(picks, "evidence_id string, position long")


NOVELTY = {"source": 4.0, "compound": 8.0, "document": 3.0, "organism": 3.0}


def representative_base() -> Column:
    """Score of a row before novelty: match, review, conflict, negative result, mechanism, application, confidence."""
    c = F.col
    return (F.least(F.lit(5.0), c("match_score")) + F.when(c("review_status") == "APPROVED", 8.0).otherwise(1.0)
            + F.when(c("conflict_group").isNull(), 0.0).otherwise(6.0) + F.when(pg.is_inactive("activity_data"), 5.0).otherwise(0.0)
            + F.when(nz("mechanism").isNotNull(), 4.0).otherwise(0.0) + F.when(pg.is_application("application"), 3.0).otherwise(0.0)
            + F.coalesce("model_confidence", F.lit(0.0)))


def representative_selection(evidence: DataFrame, limit: int = 80, per_compound: int = 3) -> DataFrame:
    """Greedy pick in which new sources, compounds, documents and organisms earn a bonus.

    Exact pruning keeps the pool small: no more than ``per_compound`` rows of equal source, compound,
    document and organism can win, and while some of the ``limit`` best compounds is unused it offers
    at least its base plus the compound bonus, which a row far below can never beat. A bonus once spent
    never comes back, so scores only fall: Spark returns the STEP_ROWS best rows of the moment, and picks
    go on among them until the best is behind the last of them, where a row not read may lead. The first
    of a step always wins, so there are at most ``limit`` steps.
    """
    fold = lambda f: F.lower(F.trim(F.coalesce(f, F.lit(""))))
    e = evidence.where(~pg.looks_non_compound(F.col("compound_name"), F.col("structure_type"), F.col("source_category")))
    narrow = e.select("evidence_id", "rank", representative_base().alias("b"), fold("source_category").alias("source"), compound_key().alias("compound"),
                      F.col("document_id").cast("string").alias("document"), fold("organism").alias("organism"))
    w = W.partitionBy("source", "compound", "document", "organism").orderBy(F.col("b").desc(), "evidence_id")
    pool = narrow.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_compound).drop("_n")
    best = pool.groupBy("compound").agg(F.max("b").alias("b")).orderBy(F.col("b").desc()).limit(limit)
    tops = [r.b for r in best.collect()]  # at most ``limit`` numbers
    if len(tops) >= limit:
        slack = sum(NOVELTY.values()) - NOVELTY["compound"]
        pool = pool.where(F.col("b") >= tops[-1] - slack)
    pool = cut(pool)
    used: dict[str, set] = {k: set() for k in NOVELTY}
    count: dict[str, int] = {}
    picked: list[str] = []

    def bonus(k: str, values: set) -> Column:
        return F.when(F.col(k).isin(sorted(v for v in values if v is not None)), 0.0).otherwise(NOVELTY[k]) if values - {None} else F.lit(NOVELTY[k])

    def place(r) -> tuple:  # adds in the order in which the columns are added
        worth = reduce(operator.add, [0.0 if r[k] is not None and r[k] in used[k] else v for k, v in NOVELTY.items()], r.b)
        return -math.floor(worth * 1e9 + 0.5), r.evidence_id

    while len(picked) < limit:
        rest = pool.where(~F.col("evidence_id").isin(picked)) if picked else pool
        full = [k for k, n in count.items() if n >= per_compound]
        rest = rest.where(~F.col("compound").isin(full)) if full else rest
        score = F.col("b")
        for k in NOVELTY:
            score = score + bonus(k, used[k])
        step = rest.orderBy(-round_half_up(score, 9), "evidence_id").limit(STEP_ROWS).select("evidence_id", "b", *NOVELTY).collect()
        if not step:
            break
        bound = place(step[-1]) if len(step) == STEP_ROWS else None
        while step and len(picked) < limit:
            top = min(step, key=place)
            if bound is not None and place(top) > bound:
                break
            picked.append(top.evidence_id)
            count[top.compound] = count.get(top.compound, 0) + 1
            for k in NOVELTY:
                used[k].add(top[k])
            step = [r for r in step if r.evidence_id != top.evidence_id and count.get(r.compound, 0) < per_compound]
    if len(picked) < limit:
        rest = narrow.where(~F.col("evidence_id").isin(picked)) if picked else narrow
        picked += [r.evidence_id for r in rest.orderBy("rank", "evidence_id").limit(limit - len(picked)).select("evidence_id").collect()]
    return evidence.sparkSession.createDataFrame([(e, i + 1) for i, e in enumerate(picked)], "evidence_id string, position long")


def chunk_heuristic(chunks: DataFrame, profile_text: str, keep: int) -> DataFrame:
    """Chunks per document by section kind and profile words they contain; the best ``keep`` stay."""
    section, text = F.lower(F.coalesce("section_path", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    hit = lambda words: pg.contains_any(section, words)
    score = F.when(hit(["table", "figure", "表", "图"]), 8).otherwise(0) + F.when(
        hit(["result", "结果", "method", "方法", "abstract", "摘要"]), 4).otherwise(0)
    import re
    for word in [t for t in re.split(r"\W+", profile_text.lower()) if len(t) >= 4]:
        score = score + F.when(F.contains(text, F.lit(word)) | F.contains(section, F.lit(word)), 1).otherwise(0)
    w = W.partitionBy("document_id").orderBy(F.col("score").desc(), "chunk_index")
    return chunks.withColumn("score", score).withColumn("position", F.row_number().over(w)).where(F.col("position") <= keep)


def expand_parents(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Selected chunks plus all chunks of their document under the same parent section."""
    parent = F.lower(F.trim(F.substring_index("section_path", ">", 1)))
    wanted = selected.select("document_id", parent.alias("_p")).where("_p <> ''").distinct()
    # a section starts with the parent name, so its own first part does as well
    grown = chunks.join(wanted, "document_id").where(F.startswith(F.lower("section_path"), F.col("_p"))).select("document_id", "chunk_id")
    return grown.unionByName(selected.select("document_id", "chunk_id")).distinct()


METADATA_CAP, ABSTRACT_CAP = 3000, 2000  # characters of one document


def literature_budget(documents: DataFrame, chunks: DataFrame, max_documents: int, max_chars: int, chunks_per_document: int) -> DataFrame:
    """Characters granted to each chosen chunk when documents share one budget in order.

    ``documents(document_id, position, metadata_chars, abstract_chars)``, ``chunks(document_id, chunk_no,
    chars)`` best first. Each document may use an equal part of what its predecessors left: up to half goes to its
    metadata, a third of the rest to its abstract, the remainder in equal shares to its chunks. Only numbers of the
    at most ``max_documents`` documents meet in one array; the fold over it is a column expression.
    """
    whole = lambda a, b: F.floor(a / b).cast("long")
    n = lambda v: F.lit(v).cast("long")
    few = documents.orderBy("position").limit(max_documents)
    w = W.partitionBy("document_id").orderBy("chunk_no")
    best = chunks.join(F.broadcast(few.select("document_id")), "document_id", "left_semi").withColumn("_n", F.row_number().over(w)).where(
        F.col("_n") <= chunks_per_document).select("document_id", "chunk_no", F.col("chars").cast("long").alias("chars"))
    sizes = best.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "chars"))).alias("cs"))
    one = few.join(sizes, "document_id", "left").agg(F.sort_array(F.collect_list(F.struct(
        "position", "document_id", F.coalesce(F.col("metadata_chars").cast("long"), n(0)).alias("meta"),
        F.coalesce(F.col("abstract_chars").cast("long"), n(0)).alias("abstract"), "cs"))).alias("ds"))

    def grant(left: Column, waiting: Column, d: Column) -> Column:
        """(budget, share of a chunk, characters used) of a document before which ``left`` characters remain."""
        budget = F.greatest(n(1), whole(left, waiting))
        head = F.least(d["meta"], n(METADATA_CAP), F.greatest(n(1), whole(budget, n(2))))
        both = head + F.least(d["abstract"], n(ABSTRACT_CAP), whole(F.greatest(n(0), budget - head), n(3)))
        share = F.greatest(n(1), whole(F.greatest(n(0), budget - both), F.greatest(F.size(d["cs"]), F.lit(1))))
        used = both + F.aggregate(F.coalesce(d["cs"], F.array().cast("array<struct<chunk_no:long,chars:long>>")), n(0), lambda a, x: a + F.least(x["chars"], share))
        return F.struct(d["document_id"].alias("document_id"), budget.alias("budget"), share.alias("share"), used.alias("used"))

    def step(state: Column, d: Column) -> Column:
        got = grant(state["left"], F.size("ds") - F.size(state["plan"]), d)
        grown = F.struct(F.greatest(n(0), state["left"] - got["used"]).alias("left"), F.array_append(state["plan"], got).alias("plan"))
        return F.when(state["left"] > 0, grown).otherwise(state)

    empty = F.array().cast("array<struct<document_id:long,budget:long,share:long,used:long>>")
    plan = one.select(F.explode(F.aggregate("ds", F.struct(n(max_chars).alias("left"), empty.alias("plan")), step)["plan"]).alias("p")).select("p.*")
    return best.join(F.broadcast(plan), "document_id").select("document_id", "chunk_no", F.least("chars", "share").alias("chars"), "budget").where("chars > 0")


def multi_round_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores summed over rounds per document; queries and chunks as rows.

    ``hits(round, document_id, score, query, chunk_id)``.
    """
    per_round = hits.groupBy("round", "document_id").agg(F.max("score").alias("score"))
    total = per_round.groupBy("document_id").agg(round_half_up(F.sum("score"), 6).alias("score"), F.count("*").alias("rounds"))
    long = hits.select("document_id", F.explode(F.array(
        F.struct(F.lit("query").alias("kind"), F.col("query").alias("value")), F.struct(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("value")))).alias("x")).select(
        "document_id", "x.*").where("value IS NOT NULL").distinct()
    return total, long
