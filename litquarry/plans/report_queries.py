"""Report, counter and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions.core import round_half_up
from litquarry.operators import counters as ct, report as rp, windows as wn
from litquarry.plans.registry import query
from litquarry.plans.views import chunks, docs, evidence, labelled, r_sql, ratio_sql, reportable, sql
from litquarry.sources.tables import table

c = F.col
EV = ("evidence", "reportable")


@query("a1_status_counters", """SELECT count(*) AS total, count(*) FILTER (o_orderstatus='O') AS o, count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='P') AS p FROM orders""")
def a1(spark, d):
    return ct.status_counters(table(spark, d, "orders", "o_orderstatus"), "o_orderstatus", ["O", "F", "P"])


@query("a2_batch_counters", """SELECT o_orderkey, count(l_orderkey) AS total, count(*) FILTER (l_linestatus='F') AS finished, count(*) FILTER (l_returnflag='R') AS failed, count(*) FILTER (l_quantity>30) AS big
    FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1""")
def a2(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag", "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey")
    return ct.refresh_counters(table(spark, d, "orders", "o_orderkey"), li, "o_orderkey", {
        "total": F.lit(True), "finished": c("l_linestatus") == "F", "failed": c("l_returnflag") == "R", "big": c("l_quantity") > 30})


@query("a3_facet_counts", sql("""SELECT 'source_category' AS facet, source_category AS value, count(*) AS n FROM reportable GROUP BY ALL UNION ALL
    SELECT 'structure_type', structure_type, count(*) FROM reportable GROUP BY ALL UNION ALL SELECT 'assay_method', coalesce(nullif(assay_method, 'N'), 'unspecified'), count(*) FROM reportable GROUP BY ALL
    UNION ALL SELECT 'organism', organism, count(*) FROM reportable GROUP BY ALL""", *EV))
def a3(spark, d):
    e = reportable(spark, d).withColumn("assay_method", F.when(c("assay_method") == "N", " ").otherwise(c("assay_method")))
    return rp.facet_counts(e)


ROLL = """roll AS (SELECT lower(compound_name) AS key, min(compound_name) AS display_name, min_by(name_kind, evidence_id) AS name_kind, count(*) AS evidence_rows, count(DISTINCT document_id) AS documents,
    count(DISTINCT organism) AS organisms, count(DISTINCT structure_type) AS structures FROM reportable GROUP BY 1),
 smp AS (SELECT key, string_agg(v, '|' ORDER BY o, v) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, v) AS n FROM (SELECT lower(compound_name) AS key, activity_data AS v,
    min(evidence_id) AS o FROM reportable GROUP BY ALL)) WHERE n <= 5 GROUP BY key)"""


@query("a4_compound_rollup", sql("""SELECT key, display_name, name_kind, evidence_rows, documents, organisms, structures, samples, row_number() OVER (ORDER BY documents DESC, evidence_rows DESC, display_name, key) AS position
    FROM roll JOIN smp USING (key)""", *EV, extra=ROLL))
def a4(spark, d):
    return rp.compound_rollup(reportable(spark, d)).withColumn("samples", F.array_join("samples", "|"))


@query("a5_overview", sql("""SELECT count(*) AS evidence_rows, count(DISTINCT document_id) AS documents, count(DISTINCT organism) AS organisms, count(*) FILTER (review_status='PENDING') AS pending,
    count(*) FILTER (review_status='APPROVED') AS approved, (SELECT count(*) FROM roll) AS compounds, (SELECT count(*) FROM roll WHERE name_kind='PURE') AS pure,
    (SELECT count(*) FROM roll WHERE name_kind='EXTRACT') AS extract, (SELECT count(*) FROM roll WHERE name_kind='LOCAL') AS local FROM reportable""", *EV, extra=ROLL))
def a5(spark, d):
    return rp.overview(reportable(spark, d))


@query("a6_supplementary_samples", sql("""SELECT field, count(*) AS n, (SELECT string_agg(v, '|' ORDER BY o, v) FROM (SELECT v, min(o) AS o FROM sup s2 WHERE s2.field=sup.field GROUP BY v ORDER BY 2, 1 LIMIT 5)) AS samples
    FROM sup GROUP BY field""", *EV, extra="""sup AS (SELECT 'mechanism' AS field, trim(mechanism) AS v, evidence_id AS o FROM reportable WHERE trim(mechanism) <> '' UNION ALL SELECT 'application', application, evidence_id FROM reportable
    WHERE application IS NOT NULL UNION ALL SELECT 'activity_data', activity_data, evidence_id FROM reportable)"""))
def a6(spark, d):
    return rp.supplementary(reportable(spark, d), ["mechanism", "application", "activity_data"]).withColumn("samples", F.array_join("samples", "|"))


@query("a7_common_compounds", sql("""SELECT *, row_number() OVER (ORDER BY documents DESC, approved DESC, evidence_rows DESC, name) AS position FROM (SELECT lower(compound_name) AS key, min(compound_name) AS name,
    count(DISTINCT document_id) AS documents, count(*) FILTER (review_status='APPROVED') AS approved, count(*) AS evidence_rows, count(DISTINCT lower(organism)) AS organisms FROM reportable GROUP BY 1)""", *EV))
def a7(spark, d):
    return rp.common_compounds(reportable(spark, d))


@query("a8_document_scores", sql("""SELECT document_id, evidence_rows, compounds, """ + r_sql("s + 2.0*compounds", 6) + """ AS score FROM (SELECT document_id, count(*) AS evidence_rows, count(DISTINCT lower(compound_name)) AS compounds,
    sum(1 + model_confidence + CASE WHEN review_status='APPROVED' THEN 3 ELSE 0 END + CASE WHEN trim(mechanism)<>'' THEN 1 ELSE 0 END + CASE WHEN application IS NOT NULL THEN 1 ELSE 0 END) AS s FROM reportable GROUP BY 1)
    WHERE document_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F') ORDER BY score DESC, CAST(document_id AS VARCHAR) LIMIT 15""", *EV))
def a8(spark, d):
    e = reportable(spark, d).withColumn("match_score", c("model_confidence"))
    ok = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("document_id"))
    return rp.document_scores(e, ok)


CONF = """cg AS (SELECT *, CASE WHEN n > 1 THEN 'conflict-' || substr(sha256(k), 1, 16) END AS conflict_group FROM (SELECT *, lower(compound_name || '|' || organism || '|' || assay_method) AS k FROM reportable)
    JOIN (SELECT lower(compound_name || '|' || organism || '|' || assay_method) AS k, count(DISTINCT lower(activity_data)) AS n FROM reportable GROUP BY 1) USING (k))"""


@query("w8_conflict_groups", sql("SELECT evidence_id, conflict_group FROM cg", *EV, extra=CONF))
def w8(spark, d):
    return rp.conflicts(reportable(spark, d)).select("evidence_id", "conflict_group")


@query("a9_section_coverage", sql("""SELECT section, n, n < CASE WHEN section IN ('mechanisms','applications') THEN 3 ELSE 1 END AS missing FROM (SELECT 'background' AS section, 0 AS n UNION ALL SELECT 'classes', count(*) FROM cg UNION ALL
    SELECT 'activity', count(*) FROM cg UNION ALL SELECT 'mechanisms', count(*) FROM cg WHERE trim(mechanism)<>'' UNION ALL SELECT 'applications', count(*) FROM cg WHERE application IS NOT NULL UNION ALL
    SELECT 'safety', 0 UNION ALL SELECT 'conflicts', count(*) FROM cg WHERE conflict_group IS NOT NULL)""", *EV, extra=CONF))
def a9(spark, d):
    e = rp.conflicts(reportable(spark, d)).withColumn("cytotoxicity", F.lit(" ")).withColumn("resistance", F.lit(None).cast("string"))
    return rp.section_coverage(e)


@query("a10_comparable_groups", sql("""SELECT lower(organism) AS organism, lower(assay_method) AS assay_method, 'ec50' AS metric, 'mg/l' AS unit, count(DISTINCT evidence_id) AS members FROM reportable GROUP BY 1, 2 HAVING count(DISTINCT evidence_id) >= 2""", *EV))
def a10(spark, d):
    return rp.comparable_groups(reportable(spark, d))


@query("a19_model_usage", """SELECT event_type AS phase, 'm' || (user_id % 3) AS model, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CAST(floor(value*100+0.5) AS BIGINT)) AS BIGINT) AS elapsed_ms FROM events GROUP BY ALL""")
def a19(spark, d):
    return ct.usage(step_events(table(spark, d, "events")))


def step_events(events):
    """Events read as model calls: type is the phase, the user picks the model, the JSON count is tokens."""
    return events.select("ts", c("event_type").alias("phase"), F.concat(F.lit("m"), (c("user_id") % 3).cast("string")).alias("model"),
                         F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.floor(c("value") * 100 + 0.5).alias("elapsed_ms"))


@query("a21_potency_median", """SELECT l_suppkey AS material_id, count(*) FILTER (l_returnflag='R') AS censored, count(*) AS tested, """ + r_sql("median(CASE WHEN l_returnflag='R' AND l_quantity<5 THEN 50.0 ELSE l_quantity END)", 2) + """ AS median_lower_bound
    FROM lineitem WHERE l_returnflag='R' OR l_quantity >= 5 GROUP BY 1""")
def a21(spark, d):
    o = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity").select(
        c("l_suppkey").alias("material_id"), F.when(c("l_returnflag") == "R", "GT").otherwise("EQ").alias("relation"),
        F.when(c("l_quantity") >= 5, c("l_quantity")).alias("value"))
    return rp.potency(o)


@query("a29_experiment_outcomes", """SELECT count(*) AS total, count(*) FILTER (quality=1 AND toxic=0) AS relevant, count(*) FILTER (quality=0 AND toxic=0) AS irrelevant, count(*) FILTER (toxic=1) AS failed FROM labels""")
def a29(spark, d):
    s = F.when(c("toxic") == 1, "FAILED").when(c("quality") == 1, "RELEVANT").otherwise("IRRELEVANT")
    return ct.status_counters(table(spark, d, "labels").withColumn("status", s), "status", ["RELEVANT", "IRRELEVANT", "FAILED"])


QS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _results(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return o.select(c("o_custkey").alias("document_id"), c("o_orderpriority").alias("question_id"), c("o_orderstatus").alias("status"),
                    (c("o_totalprice") / 1000).alias("confidence"), F.lit(1).alias("evidence_rows"))


@query("a30_classification_matrix", "SELECT c_custkey AS document_id, " + ", ".join(
    f"max(o_orderstatus) FILTER (o_orderpriority='{q}') AS \"{q}_status\", max(o_totalprice/1000) FILTER (o_orderpriority='{q}') AS \"{q}_confidence\", nullif(count(o_orderkey) FILTER (o_orderpriority='{q}'), 0) AS \"{q}_rows\"" for q in QS)
    + " FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def a30(spark, d):
    cu = table(spark, d, "customer", "c_custkey").select(c("c_custkey").alias("document_id"))
    return ct.result_matrix(cu, _results(spark, d), QS)


@query("a30_failure_list", """SELECT c_custkey AS document_id, NULL AS question_id, 'DOCUMENT' AS level FROM customer WHERE c_acctbal < 0 UNION ALL SELECT o_custkey, o_orderpriority, 'QUESTION' FROM orders WHERE o_orderstatus='P'""")
def a30_fail(spark, d):
    cu = table(spark, d, "customer", "c_custkey", "c_acctbal").select(c("c_custkey").alias("document_id"), F.when(c("c_acctbal") < 0, "FAILED").otherwise("DONE").alias("status"))
    return ct.failures(cu, _results(spark, d).withColumn("status", F.when(c("status") == "P", "FAILED").otherwise(c("status"))))


# ---- scored evidence -----------------------------------------------------------------------------
TERMS = ["ring", "blue", "mg/l", "supplier#000000007"]


@query("r18_lexical_evidence_search", sql("""SELECT evidence_id, CAST(score AS INT) AS score FROM (SELECT evidence_id, CASE WHEN contains(t, 'ring') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'economy') THEN 2 ELSE 0 END +
    CASE WHEN contains(t, 'supplier#000000007') THEN 4 ELSE 0 END AS score FROM (SELECT evidence_id, lower(concat_ws(' ', compound_name, structure_type, organism, activity_data)) AS t FROM reportable)) WHERE score > 0""", *EV))
def r18(spark, d):
    return rp.lexical_search(reportable(spark, d), ["ring", "economy", "supplier#000000007"], ["compound_name", "structure_type", "organism", "activity_data"]).select("evidence_id", "score")


@query("r18_query_terms", r"""SELECT item_id, string_agg(DISTINCT t, ' ' ORDER BY t) AS terms FROM (SELECT item_id, unnest(list_concat(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9\-]{2,}'),
    regexp_extract_all(lower(text), '[\p{L}\p{N}\-]{2,}'))) AS t FROM benchmark) WHERE length(t) >= 3 AND t NOT IN ('the', 'and', 'for') GROUP BY 1""")
def r18_terms(spark, d):
    terms = rp.lexical_terms(c("text"), ["the", "and", "for"])
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.sort_array(terms), " ").alias("terms"))


FS = """fs0 AS (SELECT *, CASE WHEN contains(lower(compound_name), 'ring') THEN 5 ELSE 0 END + CASE WHEN contains(lower(structure_type), 'economy') THEN 2 ELSE 0 END + CASE WHEN contains(lower(mechanism), 'membrane') THEN 3 ELSE 0 END AS m FROM reportable),
 fsc AS (SELECT *, """ + r_sql("m + CASE WHEN review_status='APPROVED' THEN 0.4 ELSE 0.2 END + model_confidence*0.2", 6) + """ AS match_score FROM fs0 WHERE m > 0)"""
FT = ["Ring", "economy", "membrane"]


@query("r19_fielded_score_rank", sql("SELECT evidence_id, match_score, row_number() OVER (ORDER BY match_score DESC, evidence_id) AS rank FROM fsc", *EV, extra=FS))
def r19(spark, d):
    return rp.rank_evidence(reportable(spark, d), FT)


@query("r20_coverage_hint", sql("SELECT count(*) AS n, count(DISTINCT lower(compound_name)) AS compounds, count(DISTINCT lower(organism)) AS organisms FROM fsc", *EV, extra=FS))
def r20(spark, d):
    return rp.coverage_hint(rp.fielded_score(reportable(spark, d), FT))


@query("t4_diverse_selection")
def t4(spark, d):
    """One pass in score order with interacting limits has no SQL form; checked against a plain loop in the tests."""
    s = rp.lexical_search(reportable(spark, d), ["ring", "economy", "supplier#000000007"], ["compound_name", "structure_type", "organism"])
    return rp.diverse_selection(s)


@query("t5_representative_selection")
def t5(spark, d):
    """Greedy novelty pick; checked against a plain loop in the tests."""
    e = rp.fielded_score(rp.conflicts(reportable(spark, d)), FT)
    ranked = e.join(rp.rank_evidence(reportable(spark, d), FT).select("evidence_id", "rank"), "evidence_id")
    return rp.representative_selection(ranked, 80)


HEUR = """hs AS (SELECT document_id, chunk_index, chunk_id, section_path, CASE WHEN regexp_matches(lower(section_path), 'result|method|abstract') THEN 4 ELSE 0 END + CASE WHEN contains(lower(text), 'that') OR contains(lower(section_path), 'that') THEN 1 ELSE 0 END
    + CASE WHEN contains(lower(text), 'activity') OR contains(lower(section_path), 'activity') THEN 1 ELSE 0 END AS score FROM chunks)"""


@query("t8_chunk_heuristic", sql("SELECT * FROM (SELECT document_id, chunk_id, score, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) AS position FROM hs) WHERE position <= 12", "lines", "chunks", extra=HEUR))
def t8(spark, d):
    return rp.chunk_heuristic(chunks(spark, d), "That is the activity", 12).select("document_id", "chunk_id", "score", "position")


@query("t9_parent_section_expansion", sql("""SELECT DISTINCT c.document_id, c.chunk_id FROM chunks c JOIN (SELECT document_id, chunk_id, section_path FROM hs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) <= 2) s
    ON s.document_id=c.document_id AND (s.chunk_id=c.chunk_id OR starts_with(lower(c.section_path), lower(trim(split_part(s.section_path, '>', 1)))))""", "lines", "chunks", extra=HEUR))
def t9(spark, d):
    t = chunks(spark, d)
    return rp.expand_parents(rp.chunk_heuristic(t, "That is the activity", 2), t)


BUDGET = HEUR + r""", few AS (SELECT *, row_number() OVER (ORDER BY document_id) AS i, count(*) OVER () AS n FROM
      (SELECT document_id, length(title) AS meta, length(text) - length(title) AS abstract FROM docs ORDER BY document_id LIMIT 8)),
    best AS (SELECT h.document_id, row_number() OVER (PARTITION BY h.document_id ORDER BY h.score DESC, h.chunk_index) AS chunk_no, length(c.text) AS chars
      FROM hs h JOIN chunks c ON c.chunk_id=h.chunk_id WHERE h.document_id IN (SELECT document_id FROM few) QUALIFY chunk_no <= 4),
    cs AS (SELECT document_id, list(chars) AS sizes FROM best GROUP BY 1),
    d AS (SELECT few.*, coalesce(sizes, []) AS sizes FROM few LEFT JOIN cs USING (document_id)),
    start AS (SELECT 0 AS i, 20000 AS remaining, 0::BIGINT AS document_id, 0::BIGINT AS budget, 0::BIGINT AS share),
    fold AS (SELECT * FROM start UNION ALL SELECT i, greatest(0, remaining - spent - list_sum(list_transform(sizes, lambda x: least(x, share)))), document_id, budget, share FROM (
      SELECT *, greatest(1, greatest(0, budget - spent) // greatest(len(sizes), 1)) AS share FROM (
      SELECT *, head + least(abstract, 2000, greatest(0, budget - head) // 3) AS spent FROM (
      SELECT *, least(meta, 3000, greatest(1, budget // 2)) AS head FROM (
      SELECT d.i, d.document_id, d.meta, d.abstract, d.sizes, f.remaining, greatest(1, f.remaining // (d.n - f.i)) AS budget FROM fold f JOIN d ON d.i = f.i + 1 WHERE f.remaining > 0)))))"""


@query("t10_literature_budget", sql("SELECT b.document_id, chunk_no, least(chars, share) AS chars, budget FROM best b JOIN fold ON fold.document_id=b.document_id AND fold.i > 0",
                                    "docs", "lines", "chunks", extra=BUDGET).replace("WITH docs", "WITH RECURSIVE docs", 1))
def t10(spark, d):
    """What follows the title stands in for the abstract."""
    t = docs(spark, d)
    dd = t.select("document_id", c("document_id").alias("position"), F.length("title").alias("metadata_chars"), (F.length("text") - F.length("title")).alias("abstract_chars"))
    ch = rp.chunk_heuristic(chunks(spark, d), "That is the activity", 4).select("document_id", c("position").alias("chunk_no"), F.length("text").alias("chars"))
    return rp.literature_budget(dd, ch, 8, 20_000, 4)


@query("u6_multi_round_hits", """SELECT document_id, """ + r_sql("sum(s)", 6) + """ AS score, count(*) AS rounds FROM (SELECT l_linenumber % 2 AS r, l_partkey AS document_id, max(l_discount) AS s FROM lineitem GROUP BY ALL) GROUP BY 1""")
def u6(spark, d):
    li = table(spark, d, "lineitem", "l_linenumber", "l_partkey", "l_discount", "l_returnflag", "l_suppkey")
    return rp.multi_round_hits(li.select((c("l_linenumber") % 2).alias("round"), c("l_partkey").alias("document_id"), c("l_discount").alias("score"),
                                         c("l_returnflag").alias("query"), c("l_suppkey").cast("string").alias("chunk_id")))[0]


@query("u6_multi_round_support", """SELECT DISTINCT l_partkey AS document_id, 'query' AS kind, l_returnflag AS value FROM lineitem UNION SELECT l_partkey, 'chunk', l_suppkey::VARCHAR FROM lineitem""")
def u6_support(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_returnflag", "l_suppkey")
    return rp.multi_round_hits(li.select(F.lit(1).alias("round"), c("l_partkey").alias("document_id"), F.lit(1.0).alias("score"),
                                         c("l_returnflag").alias("query"), c("l_suppkey").cast("string").alias("chunk_id")))[1]
