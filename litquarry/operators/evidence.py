"""Evidence rows: classification checks, row validation, versions, verdicts, matching and scoring."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from litquarry.functions import cells as ce
from litquarry.functions.core import nz, ratio, round_half_up, squash_space
from litquarry.operators.relational import prf
from litquarry.scale import cut, small_side, spread, stored

STATUS_RANK = {"SUPPORTED": 3, "UNCERTAIN": 2, "NOT_SUPPORTED": 1}
LABEL_RANK = {"RELEVANT": 3, "DISTRACTOR": 2, "IRRELEVANT": 1}
SUPPORT_MIN, UNCERTAIN_MIN = 0.70, 0.40
STRICT, LENIENT = 0.92, 0.55
MAX_RECOVERY_CANDIDATES = 40


@dataclass(frozen=True)
class Profile:
    """What one question extracts: its columns, which of them identify a row, and its version."""

    question_id: str
    headers: tuple[str, ...]
    primary: tuple[int, ...]
    version: str = "v1"


def _rank(col: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), col), F.lit(0))


# ---- classification ------------------------------------------------------------------------------

def validate_classifications(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """Final status per (document, question) after checking cited chunks and confidence.

    ``raw(document_id, question_id, declared, confidence, chunk_ids)``, ``chunks(document_id, chunk_id)``.
    """
    c = F.col
    key = ["document_id", "question_id"]
    cited = raw.select(*key, F.explode(F.array_distinct(F.filter("chunk_ids", lambda x: nz(x).isNotNull()))).alias("chunk_id"))
    known = chunks.select("document_id", "chunk_id").distinct().withColumn("_known", F.lit(1))
    per = cited.join(known, ["document_id", "chunk_id"], "left").groupBy(*key).agg(
        F.count("*").alias("_asked"), F.count("_known").alias("_valid"),
        # as many ids as the one input row cited
        F.array_sort(F.collect_list(F.when(c("_known") == 1, c("chunk_id")))).alias("_ids"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0))))
    j = raw.join(per, key, "left").na.fill(0, ["_asked", "_valid"]).withColumn("confidence", conf).withColumn(
        "declared", F.upper(F.trim(F.coalesce("declared", F.lit("")))))
    bad = c("_valid") != c("_asked")
    known_status = c("declared").isin(*STATUS_RANK)
    status = (F.when(~known_status, "INVALID_STATUS").when(c("declared") == "NOT_SUPPORTED", "NOT_SUPPORTED")
              .when((c("declared") == "SUPPORTED") & (c("confidence") >= SUPPORT_MIN) & (c("_valid") > 0) & ~bad, "SUPPORTED")
              .when((c("confidence") >= UNCERTAIN_MIN) | bad | ((c("declared") == "SUPPORTED") & (c("_valid") == 0)), "UNCERTAIN")
              .otherwise("NOT_SUPPORTED"))
    none = F.array().cast("array<string>")
    return j.select(*key, status.alias("status"), "confidence",
                    F.when(status.isin("SUPPORTED", "UNCERTAIN"), F.coalesce("_ids", none)).otherwise(none).alias("chunk_ids"))


def missing_classifications(raw: DataFrame, documents: DataFrame, questions: list[str]) -> DataFrame:
    """(document, question) pairs the classifier left out; the question list is configuration."""
    wanted = documents.select("document_id").distinct().select(
        "document_id", F.explode(F.array(*[F.lit(q) for q in questions])).alias("question_id"))
    return wanted.join(raw, ["document_id", "question_id"], "left_anti")


def _top_rows(rows: DataFrame, key: list[str], col: str, ranks: dict[str, int]) -> DataFrame:
    best = rows.groupBy(*key).agg(F.max(_rank(F.col(col), ranks)).alias("_best"))
    return rows.join(best, key).where(_rank(F.col(col), ranks) == F.col("_best")).drop("_best")


def _first_reasons(rows: DataFrame, key: list[str], order: str, limit: int, glue: str) -> DataFrame:
    once = rows.where(nz("reason").isNotNull()).groupBy(*key, "reason").agg(F.min(order).alias("_o"))
    w = W.partitionBy(*key).orderBy("_o", "reason")
    return (once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "reason"))), lambda x: x["reason"]), glue).alias("reason")))


def merge_classifications(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Highest status per (document, question) over batches, and its distinct chunks as rows.

    ``batches(document_id, question_id, batch_no, status, confidence, reason, chunk_ids)``. Confidence,
    reasons (at most three) and chunks come only from batches with the winning status.
    """
    key = ["document_id", "question_id"]
    top = _top_rows(batches, key, "status", STATUS_RANK)
    merged = top.groupBy(*key).agg(F.max("status").alias("status"), F.max("confidence").alias("confidence"))
    merged = merged.join(_first_reasons(top, key, "batch_no", 3, "; "), key, "left").withColumn(
        "reason", F.coalesce("reason", F.lit("")))
    chunk_rows = top.select(*key, F.explode("chunk_ids").alias("chunk_id")).distinct()
    return merged, chunk_rows


def merge_judgments(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One relevance label per document from partial judgments; entities and chunks as rows.

    ``outputs(document_id, part_no, label, confidence, entities, chunk_ids)``.
    """
    merged = outputs.groupBy("document_id").agg(
        F.max_by("label", _rank(F.col("label"), LABEL_RANK)).alias("label"),
        round_half_up(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("parts"))
    long = lambda kind, col: outputs.select("document_id", F.lit(kind).alias("kind"), F.explode(col).alias("value"))
    return merged, long("entity", "entities").unionByName(long("chunk", "chunk_ids")).distinct()


# ---- row validation ------------------------------------------------------------------------------

def validate_rows(rows: DataFrame, chunks: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """First failing check per row and the anchors of valid rows.

    ``rows(row_id, document_id, row_index, cells, anchors)``; an anchor is (chunk_id, exact_quote). A row
    that repeats an earlier valid row of its document is DUPLICATE_ROW.
    """
    c = F.col
    n = len(profile.headers)
    shape = (F.when(F.size("cells") != n, "CELL_COUNT")
             .when(F.exists(F.array(*[F.lit(i) for i in profile.primary]), lambda i: nz(F.get(c("cells"), i)).isNull()), "MISSING_PRIMARY")
             .when(F.coalesce(F.size("anchors"), F.lit(0)) <= 0, "NO_ANCHOR"))
    exploded = rows.select("row_id", "document_id", F.posexplode("anchors").alias("pos", "a")).select(
        "row_id", "document_id", "pos", c("a.chunk_id").alias("chunk_id"), c("a.exact_quote").alias("quote"))
    text = chunks.select("document_id", "chunk_id", c("text").alias("_text"), F.lit(1).alias("_known"))
    checked = exploded.join(text, ["document_id", "chunk_id"], "left").withColumn(
        "code", F.when(nz("chunk_id").isNull() | nz("quote").isNull(), "EMPTY_ANCHOR").when(c("_known").isNull(), "UNKNOWN_CHUNK")
        .when(~ce.quote_in(c("_text"), c("quote")), "QUOTE_NOT_IN_CHUNK"))
    first_bad = checked.where("code IS NOT NULL").groupBy("row_id").agg(F.min_by("code", "pos").alias("_anchor_code"))
    coded = rows.join(first_bad, "row_id", "left").select(
        "row_id", "document_id", "row_index", F.coalesce(shape, c("_anchor_code")).alias("code"),
        ce.row_fingerprint(F.lit(profile.question_id), c("cells")).alias("fingerprint"))
    first = coded.where("code IS NULL").groupBy("document_id", "fingerprint").agg(F.min_by("row_id", F.struct("row_index", "row_id")).alias("_first"))
    final = coded.join(first, ["document_id", "fingerprint"], "left").withColumn(
        "code", F.when(c("code").isNull() & (c("row_id") != c("_first")), "DUPLICATE_ROW").otherwise(c("code"))).drop("_first")
    anchors = checked.join(final.where("code IS NULL").select("row_id"), "row_id", "left_semi").select(
        "row_id", "chunk_id", F.trim("quote").alias("exact_quote"), F.sha2(squash_space("quote"), 256).alias("quote_hash")
    ).dropDuplicates(["row_id", "chunk_id", "quote_hash"])
    return final, anchors


def drop_failed_questions(validated: DataFrame) -> DataFrame:
    """Strict mode: one bad row rejects all rows of its document for this question."""
    bad = validated.where("code IS NOT NULL AND code <> 'DUPLICATE_ROW'").select("document_id").distinct()
    return validated.where("code IS NULL").join(bad, "document_id", "left_anti")


# ---- versions ------------------------------------------------------------------------------------

SCOPE = ["document_id", "question_id", "profile_version"]


def latest_by_fingerprint(table: DataFrame) -> DataFrame:
    """Newest current record per fingerprint inside its scope."""
    return table.where("is_current").groupBy(*SCOPE, "fingerprint").agg(
        F.max_by("record_id", F.struct("updated_at", "record_id")).alias("supersedes_record_id"))


def replace_current(table: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """New snapshot: earlier output of the same run goes, current rows in scope close, new rows point back.

    ``rows`` has the table's columns except ``is_current``, ``updated_at`` and ``supersedes_record_id``.
    """
    cols = table.columns
    same_run = rows.select("run_id", *SCOPE).distinct()
    scope = rows.select(*SCOPE).distinct().withColumn("_hit", F.lit(1))
    kept = table.join(same_run, ["run_id", *SCOPE], "left_anti")
    closing = F.col("is_current") & F.col("_hit").isNotNull()
    closed = kept.join(scope, SCOPE, "left").withColumn("updated_at", F.when(closing, now).otherwise(F.col("updated_at"))).withColumn(
        "is_current", F.col("is_current") & F.col("_hit").isNull()).select(*cols)
    fresh = rows.join(latest_by_fingerprint(kept), [*SCOPE, "fingerprint"], "left").withColumn("is_current", F.lit(True)).withColumn(
        "updated_at", now).select(*cols)
    return closed.unionByName(fresh)


def coverage_recovery(candidates: DataFrame, existing: DataFrame, chunks: DataFrame, limit: int = MAX_RECOVERY_CANDIDATES):
    """Enumerated primary keys with no extracted row, the chunks to re-read, and audit counts.

    ``candidates(document_id, candidate_no, primary_cells, chunk_ids)``, ``existing(document_id, primary_cells)``,
    ``chunks(document_id, chunk_id)``. The limit per document is part of the recovery contract.
    """
    fp = ce.row_fingerprint(F.lit(":primary"), F.col("primary_cells"))
    have = existing.select("document_id", fp.alias("fp")).distinct()
    w = W.partitionBy("document_id").orderBy("candidate_no")
    missing = (candidates.withColumn("fp", fp).join(have, ["document_id", "fp"], "left_anti")
               .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n"))
    wanted = missing.select("document_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    focus = chunks.join(wanted, ["document_id", "chunk_id"], "left_semi")
    docs_missing = missing.select("document_id").distinct()
    # a document whose candidates name no known chunk is re-read whole
    whole = chunks.join(docs_missing, "document_id", "left_semi").join(focus.select("document_id").distinct(), "document_id", "left_anti")
    audit = candidates.groupBy("document_id").agg(F.count("*").alias("candidates")).join(
        existing.groupBy("document_id").agg(F.count("*").alias("existing")), "document_id", "left").join(
        missing.groupBy("document_id").agg(F.count("*").alias("missing")), "document_id", "left").na.fill(0)
    return missing, focus.unionByName(whole), audit


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """Validation status per row; a row without a verdict stays valid.

    ``rows(document_id, row_index, ...)``, ``verdicts(document_id, row_index, verdict_no, accepted, reason)``.
    """
    first = verdicts.groupBy("document_id", "row_index").agg(
        F.min_by(F.struct("accepted", "reason"), "verdict_no").alias("_v"))
    ok = F.coalesce(F.col("_v.accepted"), F.lit(True))
    out = rows.join(first, ["document_id", "row_index"], "left").withColumn(
        "validation_status", F.when(ok, "VALID").otherwise("INVALID")).withColumn(
        "verification_note", F.when(ok, F.col("_v.reason")).otherwise(F.coalesce("_v.reason", F.lit("")))).drop("_v")
    return out.where("validation_status = 'VALID'") if drop_invalid else out


# ---- reuse and caches ----------------------------------------------------------------------------

def reusable_runs(requests: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """Newest finished run with the request's reuse key, else a new run."""
    newest = runs.where("status = 'COMPLETED'").groupBy(*key).agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("reuse_run_id"))
    return requests.join(newest, key, "left").withColumn("action", F.when(F.col("reuse_run_id").isNull(), "NEW").otherwise("REUSE"))


def unfinished_documents(cohort: DataFrame, done: DataFrame) -> DataFrame:
    return cohort.join(done.where("status = 'COMPLETED'").select("run_id", "document_id").distinct(), ["run_id", "document_id"], "left_anti")


def cache_lookup(requests: DataFrame, cache: DataFrame, key: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Hits with their cached value, and misses."""
    hits = requests.join(cache.select(*key, value), key)
    return hits, requests.join(cache.select(*key), key, "left_anti")


def merge_claims(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims merged by (document, category, folded statement); chunk support as rows."""
    keyed = claims.withColumn("statement_key", F.lower(squash_space("statement")))
    key = ["document_id", "category", "statement_key"]
    merged = keyed.groupBy(*key).agg(F.min_by("statement", "claim_no").alias("statement"), F.count("*").alias("mentions"))
    return merged, keyed.select(*key, F.explode("chunk_ids").alias("chunk_id")).distinct()


# ---- matching extracted rows with gold rows ------------------------------------------------------

GROUP = ["document_id", "question_id"]
WHOLE_GROUP = 32  # gold and predicted rows of a group that one task may compare whole


def _digest(cells: Column) -> Column:
    """Name of a signature, by which ties are broken."""
    return F.sha2(F.array_join(cells, "\u001f"), 256)


def _signatures(rows: DataFrame, profile: Profile, side: str) -> DataFrame:
    """Distinct primary cells per group with their number of copies; copies never multiply pairs."""
    primary = F.array(*[ce.fold_cell(F.get(F.col("cells"), F.lit(i))) for i in profile.primary])
    return spread(rows.select(*GROUP, primary.alias("sig")), *GROUP, "sig").groupBy(*GROUP, "sig").agg(F.count("*").alias("copies")).select(
        *GROUP, _digest(F.col("sig")).alias(side), F.col("sig").alias(f"{side}_cells"),
        F.transform("sig", ce.cell_parts).alias(f"{side}_parts"), F.col("copies").alias(f"{side}_copies"))


def _field_keys(part: Column, header: str, threshold: float, gold: bool) -> Column:
    """Keys that two cells of one field share whenever their similarity is at least ``threshold``.

    Text: two token sets with Jaccard >= t overlap in their prefixes of size n - ceil(t n) + 1 under
    one fixed token order; cells without tokens meet on their whole text. Numbers: values within 20
    percent fall into the same or a neighbouring logarithmic bucket, so one side names its bucket and
    the other three. Two numbers meet on buckets only; tokens join a number with a text cell.
    """
    n = F.size(part["tokens"])
    length = F.greatest(F.lit(1), (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"))
    words = F.when(n > 0, F.slice(F.sort_array(part["tokens"]), 1, length)).otherwise(F.array(F.concat(F.lit("="), part["text"])))
    if not any(h in header.lower() for h in ce.NUMERIC_HEADERS):
        return words
    num = part["number"]
    bucket = F.floor(F.log(F.abs(num)) / F.log(F.lit(1.25)))
    sign = F.when(num < 0, "#-").otherwise("#")
    buckets = F.array(*[F.concat(sign, (bucket + d).cast("string")) for d in ((0,) if gold else (-1, 0, 1))])
    tag = lambda t: F.transform(words, lambda w: F.concat(F.lit(t), w))
    tagged = lambda *tags: F.flatten(F.array(*[tag(t) for t in tags]))
    own, other = ("a:", "b:") if gold else ("b:", "a:")
    return F.when(num.isNull(), tagged(other, "c:")).otherwise(
        F.concat(F.when(num == 0, F.array(F.lit("#zero"))).otherwise(buckets), tagged(own)))


def _blocks(sigs: DataFrame, side: str, profile: Profile, threshold: float) -> DataFrame:
    """Blocking keys of each signature: a match agrees on a key of some two fields at once.

    With m fields and mean at least t, the second best field reaches (m t - 1) / (m - 1), so keys
    are pairs of field keys at that level; a field that is constant in a document blocks nothing alone.
    """
    m = len(profile.primary)
    need = threshold if m == 1 else (m * threshold - 1) / (m - 1)
    if need <= 0:
        raise ValueError(f"threshold {threshold} is too low to block {m} primary fields")
    per = sigs.select(*GROUP, side, *[_field_keys(F.get(f"{side}_parts", F.lit(p)), profile.headers[i], need, side == "g").alias(f"_k{p}")
                                      for p, i in enumerate(profile.primary)])
    if m == 1:
        return per.select(*GROUP, side, F.lit(0).alias("fields"), F.explode("_k0").alias("k1"), F.lit("").alias("k2"))
    out = None
    for i in range(m):
        for j in range(i + 1, m):
            part = per.select(*GROUP, side, F.lit(i * m + j).alias("fields"), F.explode(f"_k{i}").alias("k1"), f"_k{j}").select(
                *GROUP, side, "fields", "k1", F.explode(f"_k{j}").alias("k2"))
            out = part if out is None else out.unionByName(part)
    return out


def _scored(pairs: DataFrame, profile: Profile, threshold: float) -> DataFrame:
    sims = [ce.parts_similarity(F.get("g_parts", F.lit(pos)), F.get("p_parts", F.lit(pos)), ce.field_kind(F.lit(profile.headers[i])))
            for pos, i in enumerate(profile.primary)]
    score = sum(sims[1:], sims[0]) / len(sims)
    return pairs.withColumn("score", round_half_up(score, 6)).where(F.col("score") >= threshold)


def _whole_pairs(gold: DataFrame, predicted: DataFrame, profile: Profile, threshold: float) -> DataFrame:
    """Similar pairs of groups of few rows: each side is moved once, by group, and compared there."""
    def sigs(rows: DataFrame, side: str) -> DataFrame:
        primary = F.array(*[ce.fold_cell(F.get(F.col("cells"), F.lit(i))) for i in profile.primary])
        counted = spread(rows.select(*GROUP, primary.alias("sig")), *GROUP).groupBy(*GROUP, "sig").agg(F.count("*").alias(f"{side}_copies"))
        return counted.select(*GROUP, F.col("sig").alias(f"{side}_cells"), F.transform("sig", ce.cell_parts).alias(f"{side}_parts"), f"{side}_copies")

    near = _scored(sigs(gold, "g").join(sigs(predicted, "p"), GROUP), profile, threshold)
    return near.withColumns({side: _digest(F.col(f"{side}_cells")) for side in "gp"})


def _blocked_pairs(gold: DataFrame, predicted: DataFrame, profile: Profile, threshold: float) -> DataFrame:
    """Similar pairs of groups of any size. Candidates come from an equi join on blocking keys, which no qualifying pair
    can miss; nothing is compared with a whole group."""
    # each side is read twice, for blocking and for scoring
    g, p = cut(_signatures(gold, profile, "g")), cut(_signatures(predicted, profile, "p"))
    cand = spread(_blocks(g, "g", profile, threshold).join(
        _blocks(p, "p", profile, threshold), [*GROUP, "fields", "k1", "k2"]).select(*GROUP, "g", "p"), *GROUP, "g", "p").distinct()
    return _scored(cand.join(g, [*GROUP, "g"]).join(p, [*GROUP, "p"]), profile, threshold)


def _similar_parts(gold: DataFrame, predicted: DataFrame, profile: Profile, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Similar pairs of the groups that one task compares whole, and of the larger ones if there are any.

    A group of up to ``WHOLE_GROUP`` rows of both sides has at most ``WHOLE_GROUP / 4`` pairs a row, which is less than
    the blocking keys of a row.
    """
    known = " AND ".join(f"{k} IS NOT NULL" for k in GROUP)  # null matches no group
    gold, predicted = gold.where(known), predicted.where(known)
    sizes = gold.select(*GROUP).unionByName(predicted.select(*GROUP)).groupBy(*GROUP).agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > WHOLE_GROUP).drop("n"))
    if large.isEmpty():
        return _whole_pairs(gold, predicted, profile, threshold), None
    large = small_side(large)
    whole = _whole_pairs(gold.join(large, GROUP, "left_anti"), predicted.join(large, GROUP, "left_anti"), profile, threshold)
    return whole, _blocked_pairs(gold.join(large, GROUP, "left_semi"), predicted.join(large, GROUP, "left_semi"), profile, threshold)


def similar_rows(gold: DataFrame, predicted: DataFrame, profile: Profile, threshold: float) -> DataFrame:
    """Pairs of distinct gold and predicted primary cells in one (document, question) scoring at least ``threshold``.

    Groups of few rows are compared whole, others through blocking keys.
    """
    whole, blocked = _similar_parts(gold, predicted, profile, threshold)
    return whole if blocked is None else whole.unionByName(blocked)


def greedy_match(pairs: DataFrame, whole: bool = False) -> DataFrame:
    """One-to-one matching in order of falling score, as rows (group, g, p, score, matched copies).

    ``whole`` tells that each group has few pairs; then a task sees all of a group, and a round moves the rest once.

    A pair that is best for both its sides is what the sequential scan would take next, so all such
    pairs are taken at once and the copies they use are subtracted; rounds repeat on the rest.
    """
    if whole:
        return _match_whole(pairs)
    order = F.struct((-F.col("score")).alias("s"), F.col("g"), F.col("p"))
    left = cut(pairs.select(*GROUP, "g", "p", "g_copies", "p_copies", "score", order.alias("o")))
    taken = []
    while not left.isEmpty():
        bg = left.groupBy(*GROUP, "g").agg(F.min("o").alias("bg"))
        bp = left.groupBy(*GROUP, "p").agg(F.min("o").alias("bp"))
        won = left.join(bg, [*GROUP, "g"]).join(bp, [*GROUP, "p"]).where("o = bg AND o = bp").select(
            *GROUP, "g", "p", "score", F.least("g_copies", "p_copies").alias("matched"))
        won = cut(won)
        taken.append(won)
        used_g = won.select(*GROUP, "g", F.col("matched").alias("ug"))
        used_p = won.select(*GROUP, "p", F.col("matched").alias("up"))
        left = cut(left.join(used_g, [*GROUP, "g"], "left").join(used_p, [*GROUP, "p"], "left").na.fill(0, ["ug", "up"])
                   .withColumn("g_copies", F.col("g_copies") - F.col("ug")).withColumn("p_copies", F.col("p_copies") - F.col("up"))
                   .where("g_copies > 0 AND p_copies > 0").drop("ug", "up"))
    out = pairs.select(*GROUP, "g", "p", "score", F.lit(0).cast("long").alias("matched")).limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def _match_whole(pairs: DataFrame) -> DataFrame:
    """The rounds of ``greedy_match`` inside groups of few pairs, as windows over rows that lie by group."""
    left = pairs.select(*GROUP, "g", "p", "g_copies", "p_copies", "score")
    by_g, by_p = W.partitionBy(*GROUP, "g"), W.partitionBy(*GROUP, "p")
    order, taken = F.struct((-F.col("score")).alias("s"), "g", "p"), []
    while not taken or not left.isEmpty():
        best = left.withColumn("o", order).withColumn("bg", F.min("o").over(by_g)).withColumn("bp", F.min("o").over(by_p))
        best = best.withColumn("matched", F.when((F.col("o") == F.col("bg")) & (F.col("o") == F.col("bp")), F.least("g_copies", "p_copies"))).drop("o", "bg", "bp")
        used = best.withColumn("ug", F.coalesce(F.max("matched").over(by_g), F.lit(0))).withColumn("up", F.coalesce(F.max("matched").over(by_p), F.lit(0)))
        state = stored(used.withColumn("g_copies", F.col("g_copies") - F.col("ug")).withColumn("p_copies", F.col("p_copies") - F.col("up"))
                       .drop("ug", "up").where("matched IS NOT NULL OR (g_copies > 0 AND p_copies > 0)"))
        taken.append(state.where("matched IS NOT NULL").select(*GROUP, "g", "p", "score", "matched"))
        left = spread(state.where("matched IS NULL").drop("matched"), *GROUP)
    return reduce(DataFrame.unionByName, taken)


def score_rows(gold: DataFrame, predicted: DataFrame, profile: Profile, threshold: float) -> DataFrame:
    """Row-level TP, FP, FN with precision, recall and F1 per question."""
    whole, blocked = _similar_parts(gold, predicted, profile, threshold)
    # inside a small group the place of a digest stands for it: the order is the same and the rows are short
    place = lambda side: F.dense_rank().over(W.partitionBy(*GROUP).orderBy(side)).alias(side)
    matched = greedy_match(whole.select(*GROUP, place("g"), place("p"), "g_copies", "p_copies", "score"), whole=True).drop("g", "p")
    if blocked is not None:
        matched = matched.unionByName(greedy_match(blocked).drop("g", "p"))
    tp = matched.groupBy("question_id").agg(F.sum("matched").alias("tp"))
    total = lambda df, name: df.groupBy("question_id").agg(F.count("*").alias(name))
    # a predicted row counts even where its document has no gold rows
    j = total(gold, "n_gold").join(total(predicted, "n_pred"), "question_id", "full").join(tp, "question_id", "left").na.fill(0)
    return prf(j.select("question_id", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn")))


def field_outcomes(pairs: DataFrame, headers: list[str]) -> DataFrame:
    """Correct, partial, wrong and missing counts per field over matched pairs ``(gold_cells, pred_cells)``."""
    long = pairs.select(F.posexplode(F.array(*[F.lit(h) for h in headers])).alias("i", "field"), "gold_cells", "pred_cells")
    c = F.col
    g, p = F.coalesce(F.get("gold_cells", c("i")), F.lit("")), F.coalesce(F.get("pred_cells", c("i")), F.lit(""))
    kind = ce.field_kind("field")
    sim = ce.cell_similarity(g, p, kind)
    outcome = (F.when(nz(g).isNull() & nz(p).isNull(), "correct").when(nz(g).isNotNull() & nz(p).isNull(), "missing")
               .when(sim >= STRICT, "correct").when(sim >= LENIENT, "partial").otherwise("wrong"))
    r = long.select("field", kind.alias("kind"), outcome.alias("o")).groupBy("field", "kind").agg(
        *[F.count_if(c("o") == o).alias(o) for o in ("correct", "partial", "wrong", "missing")], F.count("*").alias("total"))
    return r.withColumn("accuracy", ratio(c("correct"), c("total")))


def anchor_support(rows: DataFrame) -> DataFrame:
    """Anchors that name a chunk and a quote; a row without anchors counts as one unsupported."""
    c = F.col
    full = F.size(F.filter("anchors", lambda a: nz(a["chunk_id"]).isNotNull() & nz(a["exact_quote"]).isNotNull()))
    n = F.coalesce(F.size("anchors"), F.lit(0))
    return rows.groupBy("question_id").agg(
        F.sum(F.when(n > 0, full).otherwise(0)).alias("supported"), F.sum(F.greatest(n, F.lit(1))).alias("total")).withColumn(
        "faithfulness", ratio(c("supported"), c("total")))


# ---- observations --------------------------------------------------------------------------------

def observations(bundles: DataFrame) -> DataFrame:
    """One row per observation of nested experiments: ``bundles(bundle_id, experiments)``."""
    c = F.col
    return (bundles.select("bundle_id", F.explode("experiments").alias("e")).select("bundle_id", "e", F.explode("e.groups").alias("g"))
            .select("bundle_id", c("e.domain").alias("domain"), c("e.target").alias("target"), c("g.role").alias("role"),
                    c("g.material_id").alias("material_id"), F.explode("g.observations").alias("o"))
            .select("bundle_id", "domain", "target", "role", "material_id", "o.*"))


def bundle_metrics(bundles: DataFrame) -> DataFrame:
    c = F.col
    obs = observations(bundles).groupBy("bundle_id").agg(
        F.count("*").alias("observations"), F.count_if(c("role") == "TEST").alias("test_observations"),
        F.count_if(c("role") == "POSITIVE_CONTROL").alias("control_observations"))
    exps = bundles.select("bundle_id", F.size("experiments").alias("experiments"),
                          F.size(F.filter("experiments", lambda e: e["domain"] == "EFFICACY")).alias("efficacy_experiments"))
    return exps.join(obs, "bundle_id", "left").na.fill(0)


def reconcile(direct: DataFrame, legacy: DataFrame) -> DataFrame:
    """Legacy observations against direct ones on (material, target): value, relation and unit flags."""
    key = ["bundle_id", "material_id", "target"]
    test = lambda df: df.where("domain = 'EFFICACY' AND role = 'TEST'")
    d = test(direct).select(*key, F.struct("value", "relation", "unit").alias("d"))
    l = test(legacy).select(*key, F.struct("value", "relation", "unit").alias("l"))
    j = l.join(d, key, "left")
    found = F.col("d").isNotNull()
    return j.select(*key, (found & F.col("l.value").eqNullSafe(F.col("d.value"))).alias("numeric_match"),
                    (found & (F.col("l.relation") == F.col("d.relation"))).alias("relation_match"),
                    (found & (F.col("l.unit") != F.col("d.unit"))).alias("unit_correction_required"))


def reconcile_summary(details: DataFrame) -> DataFrame:
    c = F.col
    return details.agg(F.count("*").alias("shared"), F.count_if("numeric_match").alias("numeric_matches"),
                       F.count_if("relation_match").alias("relation_matches"),
                       F.count_if("unit_correction_required").alias("unit_corrections")).withColumn(
        "numeric_match_rate", ratio(c("numeric_matches"), c("shared")))


def _cited(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", "report_id", F.explode(F.array_distinct(F.regexp_extract_all(
        F.col("text"), F.lit(ce.CITATION), F.lit(1)))).alias("literature_no")).withColumn(
        "literature_no", F.col("literature_no").cast("int"))


def claim_provenance(claims: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claim, cited literature number, evidence and chunk ids as rows; only cited numbers count.

    ``claims(claim_id, report_id, text)``, ``evidence(report_id, literature_no, evidence_id, document_id)``,
    ``chunks(document_id, chunk_id)``.
    """
    return _cited(claims).join(evidence, ["report_id", "literature_no"]).join(chunks, "document_id", "left").select(
        "claim_id", "literature_no", "evidence_id", "document_id", "chunk_id")


def claim_provenance_counts(claims: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct evidence ids and chunk ids per claim and cited number, as counted over ``claim_provenance``.

    What a number stands for in a report does not depend on the claim, so all claims that cite it in the same reports go
    through ``claim_provenance`` as one and share its counts; no row is made per claim and evidence row.
    """
    citing = _cited(claims).groupBy("claim_id", "literature_no").agg(F.sort_array(F.collect_set("report_id")).alias("reports"))
    tag = F.concat(F.lit("[文献"), F.col("literature_no").cast("string"), F.lit("]"))
    shared = citing.select("literature_no", "reports").distinct().select(
        F.struct("literature_no", "reports").alias("claim_id"), F.explode("reports").alias("report_id"), tag.alias("text"))
    rows = claim_provenance(shared, evidence.select("report_id", "literature_no", "evidence_id", "document_id").distinct(),
                            chunks.select("document_id", "chunk_id").distinct())
    counts = cut(rows.groupBy("claim_id", "literature_no").agg(
        F.countDistinct("evidence_id").alias("evidence_rows"), F.countDistinct("chunk_id").alias("chunks")).select(
        "literature_no", F.col("claim_id.reports").alias("reports"), "evidence_rows", "chunks"))
    return citing.join(small_side(counts), ["literature_no", "reports"]).select("claim_id", "literature_no", "evidence_rows", "chunks")
