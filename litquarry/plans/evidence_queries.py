"""Evidence lifecycle, matching and relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions.core import md5_order, round_half_up
from litquarry.operators import evidence as ev, relational as rel, report as rp, windows as wn
from litquarry.plans.function_queries import similarity_sql
from litquarry.plans.registry import query
from litquarry.plans.views import chunks, docs, evidence, labelled, r_sql, ratio_sql, reportable, sql
from litquarry.sources.tables import table

c = F.col

# ---- classification tables from orders and lineitem ----------------------------------------------
CLS = """cls AS (SELECT o_custkey AS document_id, o_orderpriority AS question_id, o_orderkey AS batch_no,
    CASE o_orderstatus WHEN 'F' THEN 'SUPPORTED' WHEN 'P' THEN 'UNCERTAIN' ELSE 'NOT_SUPPORTED' END AS status,
    o_totalprice/1000000 AS confidence, CASE WHEN o_orderkey % 3 > 0 THEN 'reason ' || (o_orderkey % 5) ELSE ' ' END AS reason FROM orders)"""


def _cls(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    s = c("o_orderstatus")
    k = c("o_orderkey")
    return o.select(
        c("o_custkey").alias("document_id"), c("o_orderpriority").alias("question_id"), k.alias("batch_no"),
        F.when(s == "F", "SUPPORTED").when(s == "P", "UNCERTAIN").otherwise("NOT_SUPPORTED").alias("status"),
        (c("o_totalprice") / 1000000).alias("confidence"),
        F.when(k % 3 > 0, F.concat(F.lit("reason "), (k % 5).cast("string"))).otherwise(" ").alias("reason"),
        F.array(F.concat(F.lit("c"), (k % 7).cast("string")), F.concat(F.lit("c"), (k % 2).cast("string"))).alias("chunk_ids"))


MERGE = """top AS (SELECT * FROM (SELECT *, max(r) OVER (PARTITION BY document_id, question_id) AS best FROM (SELECT *, CASE status WHEN 'SUPPORTED'
    THEN 3 WHEN 'UNCERTAIN' THEN 2 ELSE 1 END AS r FROM cls)) WHERE r = best),
 rs AS (SELECT document_id, question_id, string_agg(reason, '; ' ORDER BY o, reason) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY document_id,
    question_id ORDER BY o, reason) AS n FROM (SELECT document_id, question_id, reason, min(batch_no) AS o FROM top WHERE trim(reason) <> '' GROUP BY ALL)) WHERE n <= 3 GROUP BY ALL),
 merged AS (SELECT document_id, question_id, max(status) AS status, max(confidence) AS confidence, coalesce(max(rs.reason), '') AS reason
    FROM top LEFT JOIN rs USING (document_id, question_id) GROUP BY ALL)"""


@query("a14_classification_merge", sql("SELECT * FROM merged", extra=CLS + ",\n" + MERGE))
def a14(spark, d):
    return ev.merge_classifications(_cls(spark, d))[0]


@query("a14_classification_chunks", sql("""SELECT DISTINCT document_id, question_id, unnest(['c' || (batch_no % 7), 'c' || (batch_no % 2)]) AS chunk_id
    FROM top""", extra=CLS + ",\n" + MERGE))
def a14_chunks(spark, d):
    return ev.merge_classifications(_cls(spark, d))[1]


@query("p7_retained_inputs", sql("SELECT document_id, question_id, status FROM merged WHERE status IN ('SUPPORTED', 'UNCERTAIN')", extra=CLS + ",\n" + MERGE))
def p7(spark, d):
    return rel.retained_inputs(a14(spark, d)).select("document_id", "question_id", "status")


RAWC = """rawc AS (SELECT o_custkey AS document_id, o_orderkey::VARCHAR AS question_id, CASE o_orderkey % 4 WHEN 0 THEN ' supported' WHEN 1 THEN 'UNCERTAIN'
    WHEN 2 THEN 'SUPPORTED' ELSE CASE WHEN o_orderkey % 8 = 3 THEN 'NOT_SUPPORTED' ELSE 'maybe' END END AS declared, o_totalprice/500000 AS confidence,
    o_orderkey FROM orders),
 citedc AS (SELECT DISTINCT document_id, question_id, unnest([document_id || ':' || (o_orderkey % 6), document_id || ':' || (o_orderkey % 3)]) AS chunk_id FROM rawc),
 knownc AS (SELECT c_custkey AS document_id, c_custkey || ':' || n AS chunk_id FROM customer, (SELECT unnest([0,1,2,3]) AS n))"""


def _raw_cls(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k, doc = c("o_orderkey"), c("o_custkey").cast("string")
    declared = (F.when(k % 4 == 0, " supported").when(k % 4 == 1, "UNCERTAIN").when(k % 4 == 2, "SUPPORTED")
                .when(k % 8 == 3, "NOT_SUPPORTED").otherwise("maybe"))
    raw = o.select(c("o_custkey").alias("document_id"), k.cast("string").alias("question_id"), declared.alias("declared"),
                   (c("o_totalprice") / 500000).alias("confidence"),
                   F.array(F.concat_ws(":", doc, (k % 6).cast("string")), F.concat_ws(":", doc, (k % 3).cast("string"))).alias("chunk_ids"))
    known = table(spark, d, "customer", "c_custkey").select(
        c("c_custkey").alias("document_id"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("n")).select(
        "document_id", F.concat_ws(":", "document_id", "n").alias("chunk_id"))
    return raw, known


@query("d7_classification_validation", sql("""SELECT document_id, question_id, confidence, status, CASE WHEN status IN ('SUPPORTED','UNCERTAIN')
      THEN coalesce(ids, '') ELSE '' END AS chunk_ids FROM (SELECT *, CASE WHEN d NOT IN ('SUPPORTED','UNCERTAIN','NOT_SUPPORTED') THEN 'INVALID_STATUS'
      WHEN d='NOT_SUPPORTED' THEN 'NOT_SUPPORTED' WHEN d='SUPPORTED' AND confidence>=0.7 AND valid>0 AND valid=asked THEN 'SUPPORTED'
      WHEN confidence>=0.4 OR valid<>asked OR (d='SUPPORTED' AND valid=0) THEN 'UNCERTAIN' ELSE 'NOT_SUPPORTED' END AS status FROM
      (SELECT r.document_id, r.question_id, upper(trim(declared)) AS d, least(1.0, greatest(0.0, confidence)) AS confidence, count(c.chunk_id) AS asked,
       count(k.chunk_id) AS valid, string_agg(k.chunk_id, ',' ORDER BY k.chunk_id) AS ids FROM rawc r LEFT JOIN citedc c USING (document_id, question_id)
       LEFT JOIN knownc k ON k.document_id=r.document_id AND k.chunk_id=c.chunk_id GROUP BY ALL))""", extra=RAWC))
def d7(spark, d):
    out = ev.validate_classifications(*_raw_cls(spark, d))
    return out.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("d7_missing_classifications", """SELECT c_custkey AS document_id, q AS question_id FROM customer, (SELECT DISTINCT o_orderpriority AS q FROM orders)
    WHERE (c_custkey, q) NOT IN (SELECT o_custkey, o_orderpriority FROM orders)""")
def d7_missing(spark, d):
    qs = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cu = table(spark, d, "customer", "c_custkey").select(c("c_custkey").alias("document_id"))
    return ev.missing_classifications(_cls(spark, d), cu, qs)


@query("a15_judgment_merge", """SELECT o_custkey AS document_id, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'RELEVANT'
    WHEN 2 THEN 'DISTRACTOR' ELSE 'IRRELEVANT' END AS label, """ + r_sql("avg(o_totalprice/1000000)", 6) + """ AS confidence, count(*) AS parts FROM orders GROUP BY 1""")
def a15(spark, d):
    return ev.merge_judgments(_judgments(spark, d))[0]


def _judgments(spark, d):
    s = c("status")
    lab = F.when(s == "SUPPORTED", "RELEVANT").when(s == "UNCERTAIN", "DISTRACTOR").otherwise("IRRELEVANT")
    return _cls(spark, d).select("document_id", c("batch_no").alias("part_no"), lab.alias("label"), "confidence",
                                 F.array("question_id").alias("entities"), "chunk_ids")


@query("a15_judgment_entities", """SELECT DISTINCT o_custkey AS document_id, 'entity' AS kind, o_orderpriority AS value FROM orders UNION
    SELECT o_custkey, 'chunk', unnest(['c' || (o_orderkey % 7), 'c' || (o_orderkey % 2)]) FROM orders""")
def a15_lists(spark, d):
    return ev.merge_judgments(_judgments(spark, d))[1]


# ---- row validation ------------------------------------------------------------------------------
ROWS = """erow AS (SELECT chunk_id AS row_id, document_id, chunk_index AS row_index, text, split_part(text, ' ', 1) AS w1, split_part(text, ' ', 2) AS w2, section_path FROM chunks),
 coded AS (SELECT *, CASE WHEN row_index % 17 = 5 THEN 'CELL_COUNT' WHEN row_index % 13 = 6 OR trim(w1)='' THEN 'MISSING_PRIMARY' WHEN row_index % 11 = 3 THEN 'NO_ANCHOR'
    WHEN trim(w1 || ' ' || w2) = '' THEN 'EMPTY_ANCHOR' WHEN row_index % 7 = 2 THEN 'UNKNOWN_CHUNK' WHEN row_index % 5 = 4 THEN 'QUOTE_NOT_IN_CHUNK' END AS code,
    sha256('Q1' || chr(31) || lower(concat_ws(chr(31), CASE WHEN row_index % 13 = 6 THEN '' ELSE trim(w1) END, trim(w2), CASE WHEN row_index % 17 = 5 THEN NULL ELSE section_path END))) AS fingerprint FROM erow)"""
PROFILE = ev.Profile("Q1", ("Compound", "Activity", "Section"), (0,))


def _rows(spark, d):
    t = chunks(spark, d)
    i = c("chunk_index")
    w1, w2 = F.split_part(c("text"), F.lit(" "), F.lit(1)), F.split_part(c("text"), F.lit(" "), F.lit(2))
    quote = F.when(i % 5 == 4, F.lit("~ not there ~")).otherwise(F.concat(w1, F.lit("  "), w2))
    cid = F.when(i % 7 == 2, "nowhere").otherwise(c("chunk_id"))
    cells = F.when(i % 17 == 5, F.array(w1, w2)).otherwise(F.array(F.when(i % 13 == 6, " ").otherwise(w1), w2, c("section_path")))
    anchor = F.struct(cid.alias("chunk_id"), quote.alias("exact_quote"))
    anchors = F.when(i % 11 == 3, F.array().cast("array<struct<chunk_id:string,exact_quote:string>>")).otherwise(F.array(anchor, anchor))
    return t.select(c("chunk_id").alias("row_id"), "document_id", i.alias("row_index"), cells.alias("cells"), anchors.alias("anchors")), t


@query("d8_row_validation", sql("""SELECT row_id, document_id, row_index, fingerprint, CASE WHEN code IS NULL AND row_number() OVER (PARTITION BY document_id, fingerprint,
    code IS NULL ORDER BY row_index, row_id) > 1 THEN 'DUPLICATE_ROW' ELSE code END AS code FROM coded""", "lines", "chunks", extra=ROWS))
def d8(spark, d):
    return ev.validate_rows(*_rows(spark, d), PROFILE)[0]


@query("d8_valid_anchors", sql("""SELECT row_id, row_id AS chunk_id, w1 || '  ' || w2 AS exact_quote, sha256(trim(regexp_replace(w1 || '  ' || w2, '\\s+', ' ', 'g'))) AS quote_hash FROM
    (SELECT *, row_number() OVER (PARTITION BY document_id, fingerprint ORDER BY row_index, row_id) AS n FROM coded WHERE code IS NULL) WHERE n = 1""".replace("w1 || '  ' || w2 AS", "trim(w1 || '  ' || w2) AS"),
    "lines", "chunks", extra=ROWS))
def d8_anchors(spark, d):
    return ev.validate_rows(*_rows(spark, d), PROFILE)[1]


@query("d8_strict_documents", sql("""SELECT row_id FROM coded WHERE code IS NULL AND document_id NOT IN (SELECT document_id FROM coded WHERE code IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY document_id, fingerprint ORDER BY row_index, row_id) = 1""", "lines", "chunks", extra=ROWS))
def d8_strict(spark, d):
    return ev.drop_failed_questions(ev.validate_rows(*_rows(spark, d), PROFILE)[0]).select("row_id")


# ---- versions ------------------------------------------------------------------------------------
VER = """vt AS (SELECT o_orderkey AS record_id, o_orderkey % 9 AS run_id, o_custkey AS document_id, o_orderpriority AS question_id, 'v1' AS profile_version,
    md5(o_orderstatus || o_orderkey % 4) AS fingerprint, o_orderkey % 3 > 0 AS is_current, o_orderdate AS updated_at FROM orders),
 vn AS (SELECT 10000000 + o_orderkey AS record_id, 4 AS run_id, o_custkey AS document_id, o_orderpriority AS question_id, 'v1' AS profile_version,
    md5(o_orderstatus || o_orderkey % 4) AS fingerprint FROM orders WHERE o_totalprice > 300000),
 vk AS (SELECT * FROM vt WHERE NOT (run_id = 4 AND (document_id, question_id) IN (SELECT document_id, question_id FROM vn))),
 vs AS (SELECT DISTINCT document_id, question_id FROM vn),
 vl AS (SELECT document_id, question_id, fingerprint, max_by(record_id, (updated_at, record_id)) AS sup FROM vk WHERE is_current GROUP BY ALL),
 snap AS (SELECT vk.record_id, run_id, vk.document_id, vk.question_id, fingerprint, is_current AND vs.document_id IS NULL AS is_current,
    CASE WHEN is_current AND vs.document_id IS NOT NULL THEN TIMESTAMP '2026-01-01' ELSE updated_at END AS updated_at, NULL AS supersedes_record_id
    FROM vk LEFT JOIN vs ON vs.document_id=vk.document_id AND vs.question_id=vk.question_id UNION ALL
    SELECT record_id, run_id, vn.document_id, vn.question_id, vn.fingerprint, TRUE, TIMESTAMP '2026-01-01', sup FROM vn LEFT JOIN vl
    ON vl.document_id=vn.document_id AND vl.question_id=vn.question_id AND vl.fingerprint=vn.fingerprint)"""


def _versions(spark, d):
    o = table(spark, d, "orders")
    k = c("o_orderkey")
    fp = F.md5(F.concat(c("o_orderstatus"), (k % 4).cast("string")))
    base = [c("o_custkey").alias("document_id"), c("o_orderpriority").alias("question_id"), F.lit("v1").alias("profile_version"), fp.alias("fingerprint")]
    old = o.select(k.alias("record_id"), (k % 9).alias("run_id"), *base, (k % 3 > 0).alias("is_current"), c("o_orderdate").alias("updated_at"),
                   F.lit(None).cast("long").alias("supersedes_record_id"))
    new = o.where("o_totalprice > 300000").select((k + 10000000).alias("record_id"), F.lit(4).cast("long").alias("run_id"), *base)
    return old, new


@query("d9_versioned_replace", sql("""SELECT record_id, run_id, document_id, question_id, fingerprint, is_current, strftime(updated_at, '%Y-%m-%d') AS updated_on, supersedes_record_id FROM snap""", extra=VER))
def d9(spark, d):
    old, new = _versions(spark, d)
    out = ev.replace_current(old, new, F.lit("2026-01-01").cast("timestamp"))
    return out.withColumn("updated_on", F.date_format("updated_at", "yyyy-MM-dd")).drop("updated_at", "profile_version")


@query("w14_superseded_lookup", sql("SELECT document_id, question_id, fingerprint, sup AS supersedes_record_id FROM vl", extra=VER.replace("vk AS (SELECT * FROM vt WHERE NOT (run_id = 4 AND (document_id, question_id) IN (SELECT document_id, question_id FROM vn)))", "vk AS (SELECT * FROM vt)")))
def w14(spark, d):
    return ev.latest_by_fingerprint(_versions(spark, d)[0]).drop("profile_version")


@query("w2_newest_per_reuse_key", """SELECT o_custkey, o_orderpriority, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, max(o_orderdate)::DATE AS finished FROM orders GROUP BY ALL""")
def w2(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return rel.latest_per(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"]).select(
        "o_custkey", "o_orderpriority", c("o_orderkey").alias("run_id"), c("o_orderdate").cast("date").alias("finished"))


@query("j5_latest_job_per_document", """SELECT c_custkey, c_name, o_orderkey AS last_order, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def j5(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    last = rel.latest_per(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    cu = table(spark, d, "customer", "c_custkey", "c_name")
    return cu.join(last, cu.c_custkey == last.o_custkey, "left").select(
        "c_custkey", "c_name", c("o_orderkey").alias("last_order"), "o_totalprice")


# ---- recovery, verdicts, reuse -------------------------------------------------------------------
COV = """cand AS (SELECT l_orderkey AS document_id, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS candidate_no,
    p_name AS k, l_linenumber FROM lineitem JOIN part ON p_partkey=l_partkey),
 exi AS (SELECT document_id, k FROM cand WHERE l_linenumber <= 3),
 miss AS (SELECT document_id, candidate_no, k, l_linenumber FROM cand WHERE (document_id, k) NOT IN (SELECT document_id, k FROM exi)
    QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY candidate_no) <= 40)"""


def _coverage(spark, d):
    from litquarry.scale import global_rank
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    li = global_rank(li, [], [c(x).asc() for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")], "candidate_no")
    t = li.join(table(spark, d, "part", "p_partkey", "p_name"), c("l_partkey") == c("p_partkey")).select(
        c("l_orderkey").alias("document_id"), "candidate_no", F.array("p_name").alias("primary_cells"), "l_linenumber",
        F.array(F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("chunk_ids"))
    known = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber <> 5").select(
        c("l_orderkey").alias("document_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id")).distinct()
    return ev.coverage_recovery(t.drop("l_linenumber"), t.where("l_linenumber <= 3").select("document_id", "primary_cells"), known)


@query("d10_missing_candidates", sql("SELECT document_id, candidate_no, k AS primary_key FROM miss", extra=COV))
def d10(spark, d):
    return _coverage(spark, d)[0].select("document_id", "candidate_no", F.get("primary_cells", F.lit(0)).alias("primary_key"))


@query("d10_focus_chunks", sql("""SELECT DISTINCT k.document_id, k.chunk_id FROM (SELECT DISTINCT l_orderkey AS document_id, l_orderkey || ':' || l_linenumber AS chunk_id FROM lineitem WHERE l_linenumber <> 5) k
    WHERE chunk_id IN (SELECT document_id || ':' || l_linenumber FROM miss) OR (document_id IN (SELECT document_id FROM miss) AND document_id NOT IN (SELECT document_id FROM miss WHERE l_linenumber <> 5))""", extra=COV))
def d10_focus(spark, d):
    return _coverage(spark, d)[1]


@query("d10_coverage_audit", sql("""SELECT document_id, count(*) AS candidates, count(*) FILTER (l_linenumber <= 3) AS existing, (SELECT count(*) FROM miss m WHERE m.document_id=cand.document_id) AS missing
    FROM cand GROUP BY document_id""", extra=COV))
def d10_audit(spark, d):
    return _coverage(spark, d)[2]


@query("d11_verdicts", """SELECT o_orderkey, o_custkey, CASE WHEN r = 'N' THEN 'INVALID' ELSE 'VALID' END AS validation_status, CASE WHEN r IS NULL THEN NULL WHEN r='N' THEN note ELSE note END AS verification_note
    FROM orders LEFT JOIN (SELECT l_orderkey, min_by(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS r, min_by(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS note
    FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON l_orderkey = o_orderkey""")
def d11(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("document_id", F.lit(0)).withColumn("row_index", c("o_orderkey"))
    v = table(spark, d, "lineitem").where("l_quantity > 25").select(
        F.lit(0).alias("document_id"), c("l_orderkey").alias("row_index"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("verdict_no"),
        (c("l_returnflag") != "N").alias("accepted"), c("l_linestatus").alias("reason"))
    return ev.apply_verdicts(o, v).drop("document_id", "row_index")


@query("d24_run_reuse", """SELECT c_custkey, action, reuse FROM (SELECT c_custkey, CASE WHEN r IS NULL THEN 'NEW' ELSE 'REUSE' END AS action, r AS reuse FROM customer LEFT JOIN
    (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS r FROM orders WHERE o_orderstatus='F' GROUP BY 1) ON o_custkey=c_custkey)""")
def d24(spark, d):
    req = table(spark, d, "customer", "c_custkey").withColumn("input_hash", F.sha2(c("c_custkey").cast("string"), 256))
    runs = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").select(
        c("o_orderkey").alias("run_id"), F.sha2(c("o_custkey").cast("string"), 256).alias("input_hash"), c("o_orderdate").alias("finished_at"),
        F.when(c("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status"))
    return ev.reusable_runs(req, runs, ["input_hash"]).select("c_custkey", "action", c("reuse_run_id").alias("reuse"))


@query("d24_resume_unfinished", """SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS document_id FROM lineitem WHERE (l_orderkey, l_suppkey) NOT IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus='F')""")
def d24_resume(spark, d):
    t = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linestatus").select(c("l_orderkey").alias("run_id"), c("l_suppkey").alias("document_id"),
        F.when(c("l_linestatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status"))
    return ev.unfinished_documents(t.select("run_id", "document_id").distinct(), t)


@query("d25_cache_misses", """SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'fr') OR (lang = 'fr' AND n_chars % 2 = 0)""")
def d25(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang", "n_chars", "text")
    key = ["doc_id", "content_hash", "prompt_hash", "model"]
    req = t.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit("p1").alias("prompt_hash"), F.lit("m").alias("model"))
    stale = (c("lang") == "fr") & (c("n_chars") % 2 == 0)
    cache = t.where("lang IN ('en', 'fr')").select("doc_id", F.when(stale, "stale").otherwise(F.sha2("text", 256)).alias("content_hash"),
        F.lit("p1").alias("prompt_hash"), F.lit("m").alias("model"), F.lit("{}").alias("result"))
    return ev.cache_lookup(req, cache, key, "result")[1].select("doc_id")


@query("d25_claim_merge", """SELECT l_orderkey AS document_id, l_returnflag AS category, lower(p_type || ' ' || p_brand) AS statement_key, min_by(p_type || CASE WHEN l_linenumber % 2 = 0 THEN '  ' ELSE ' ' END || p_brand,
    (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS statement, count(*) AS mentions FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY ALL""")
def d25_claims(spark, d):
    return ev.merge_claims(_claims(spark, d))[0]


def _claims(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    t = li.join(table(spark, d, "part", "p_partkey", "p_type", "p_brand"), c("l_partkey") == c("p_partkey"))
    gap = F.when(c("l_linenumber") % 2 == 0, "  ").otherwise(" ")
    return t.select(c("l_orderkey").alias("document_id"), c("l_returnflag").alias("category"), F.concat("p_type", gap, "p_brand").alias("statement"),
                    F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("claim_no"), F.array(F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("chunk_ids"))


# ---- matching ------------------------------------------------------------------------------------
MATCH_PROFILE = ev.Profile("Q1", ("Compound", "Activity data", "Organism"), (0, 1))
GOLD = """gr AS (SELECT l_orderkey AS document_id, l_returnflag AS question_id, p_name || ' ' || lower(p_type) AS a, 'mic ' || CAST(l_quantity AS INT) AS b, s_name AS o, l_linenumber FROM lineitem
    JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey),
 pd AS (SELECT document_id, question_id, CASE WHEN l_linenumber % 3 = 0 THEN split_part(a, ' ', 1) || ' extra ' || split_part(a, ' ', 3) ELSE a END AS a,
    CASE WHEN l_linenumber % 4 = 0 THEN 'about ' || CAST(floor(CAST(split_part(b, ' ', 2) AS INT) * 1.1) AS INT) ELSE b END AS b, o FROM gr WHERE l_linenumber <> 2),
 gs AS (SELECT document_id, question_id, lower(a) AS a, b, count(*) AS gc FROM gr GROUP BY ALL), ps AS (SELECT document_id, question_id, lower(a) AS x, b AS y, count(*) AS pc FROM pd GROUP BY ALL)"""
PAIRS = f"""pairs AS (SELECT * FROM (SELECT *, {r_sql(f"(({similarity_sql('a','x',chr(39)+'text'+chr(39))}) + ({similarity_sql('b','y',chr(39)+'numeric'+chr(39))}))/2", 6)} AS score
    FROM gs JOIN ps USING (document_id, question_id)) WHERE score >= 0.55)"""


def _gold_pred(spark, d):
    e = evidence(spark, d)
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    t = li.join(table(spark, d, "part", "p_partkey", "p_name", "p_type"), c("l_partkey") == c("p_partkey")).join(
        table(spark, d, "supplier", "s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"))
    q = c("l_quantity").cast("int")
    a = F.concat_ws(" ", "p_name", F.lower("p_type"))
    g = t.select(c("l_orderkey").alias("document_id"), c("l_returnflag").alias("question_id"), a.alias("a"),
                 F.concat(F.lit("MIC "), q.cast("string")).alias("b"), c("s_name").alias("o"), "l_linenumber", q.alias("q"))
    gold = g.select("document_id", "question_id", F.array("a", "b", "o").alias("cells"), "l_linenumber")
    w = lambda n: F.split_part(c("a"), F.lit(" "), F.lit(n))
    pa = F.when(c("l_linenumber") % 3 == 0, F.concat_ws(" ", w(1), F.lit("extra"), w(3))).otherwise(c("a"))
    pb = F.when(c("l_linenumber") % 4 == 0, F.concat(F.lit("about "), F.floor(c("q") * 1.1).cast("int").cast("string"))).otherwise(c("b"))
    pred = g.where("l_linenumber <> 2").select("document_id", "question_id", F.array(pa, pb, "o").alias("cells"), "l_linenumber")
    return gold, pred


@query("j8_similar_rows", sql("SELECT document_id, question_id, a || '|' || b AS gold, x || '|' || y AS predicted, gc AS gold_copies, pc AS predicted_copies, score FROM pairs", extra=GOLD + ",\n" + PAIRS))
def j8(spark, d):
    gold, pred = _gold_pred(spark, d)
    s = ev.similar_rows(gold, pred, MATCH_PROFILE, ev.LENIENT)
    return s.select("document_id", "question_id", F.array_join("g_cells", "|").alias("gold"), F.array_join("p_cells", "|").alias("predicted"),
                    c("g_copies").alias("gold_copies"), c("p_copies").alias("predicted_copies"), "score")


# rounds of mutually best pairs, as many as this data needs
def match_sql(rounds: int) -> str:
    out = ["m0 AS (SELECT *, sha256(a || chr(31) || b) AS g, sha256(x || chr(31) || y) AS p, gc AS rg, pc AS rp FROM pairs)"]
    for i in range(rounds):
        out.append(f"""w{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, question_id, g ORDER BY score DESC, g, p) AS ng,
          row_number() OVER (PARTITION BY document_id, question_id, p ORDER BY score DESC, g, p) AS np FROM m{i}) WHERE ng=1 AND np=1)""")
        out.append(f"""m{i+1} AS (SELECT * FROM (SELECT m.* REPLACE (m.rg - coalesce(least(u.rg, u.rp), 0) AS rg, m.rp - coalesce(least(v.rg, v.rp), 0) AS rp) FROM m{i} m
          LEFT JOIN w{i} u ON u.document_id=m.document_id AND u.question_id=m.question_id AND u.g=m.g
          LEFT JOIN w{i} v ON v.document_id=m.document_id AND v.question_id=m.question_id AND v.p=m.p) WHERE rg > 0 AND rp > 0)""")
    out.append("won AS (" + " UNION ALL ".join(f"SELECT document_id, question_id, a, b, x, y, score, least(rg, rp) AS matched FROM w{i}" for i in range(rounds)) + ")")
    return ",\n".join(out)


PRF_SQL = f"""{ratio_sql('tp', 'tp+fp')} AS precision, {ratio_sql('tp', 'tp+fn')} AS recall"""


def prf_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn, precision, recall, {ratio_sql('2*precision*recall', 'precision+recall')} AS f1 FROM (SELECT *, {PRF_SQL} FROM {src})"""


D16_COUNTS = """rs16 AS (SELECT question_id, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(np - coalesce(tp, 0) AS BIGINT) AS fp, CAST(ng - coalesce(tp, 0) AS BIGINT) AS fn FROM
    (SELECT question_id, count(*) AS ng FROM gr GROUP BY 1) JOIN (SELECT question_id, count(*) AS np FROM pd GROUP BY 1) USING (question_id)
    LEFT JOIN (SELECT question_id, sum(matched) AS tp FROM won GROUP BY 1) USING (question_id))"""
D16 = ",\n".join([GOLD, PAIRS, match_sql(6), D16_COUNTS])


@query("d16_row_matching", sql(prf_sql("rs16", "question_id"), extra=D16))
def d16(spark, d):
    return ev.score_rows(*_gold_pred(spark, d), MATCH_PROFILE, ev.LENIENT)


@query("a16_micro_average", sql(prf_sql("""(SELECT coalesce(question_id, '@all') AS question_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
    FROM rs16 GROUP BY ROLLUP (question_id))""", "question_id"), extra=D16))
def a16(spark, d):
    return rel.micro_average(d16(spark, d), "question_id")


FIELD_PAIRS = """fp AS (SELECT l_orderkey, p_name AS g1, CASE WHEN l_linenumber % 3 = 0 THEN p_type || ' ' || p_name WHEN l_linenumber = 5 THEN '' ELSE p_name END AS p1,
    'mic ' || CAST(l_quantity AS INT) AS g2, 'mic ' || CAST(floor(l_quantity * (1 + l_tax * 4)) AS INT) AS p2 FROM lineitem JOIN part ON p_partkey=l_partkey)"""


@query("a17_field_outcomes", sql(f"""SELECT field, kind, count(*) FILTER (s>=0.92) AS correct, count(*) FILTER (s>=0.55 AND s<0.92) AS partial, count(*) FILTER (s<0.55 AND p<>'') AS wrong,
    count(*) FILTER (p='') AS missing, count(*) AS total, {ratio_sql('count(*) FILTER (s>=0.92)', 'count(*)')} AS accuracy FROM
    (SELECT 'Compound' AS field, 'text' AS kind, lower(p1) AS p, {similarity_sql("lower(g1)", "lower(p1)", "'text'")} AS s FROM fp UNION ALL
     SELECT 'Activity data', 'numeric', p2, {similarity_sql("g2", "p2", "'numeric'")} FROM fp) GROUP BY ALL""", extra=FIELD_PAIRS))
def a17(spark, d):
    t = table(spark, d, "lineitem", "l_partkey", "l_linenumber", "l_quantity", "l_tax").join(table(spark, d, "part", "p_partkey", "p_name", "p_type"), c("l_partkey") == c("p_partkey"))
    p1 = F.when(c("l_linenumber") % 3 == 0, F.concat_ws(" ", "p_type", "p_name")).when(c("l_linenumber") == 5, "").otherwise(c("p_name"))
    num = lambda x: F.concat(F.lit("MIC "), x.cast("int").cast("string"))
    pairs = t.select(F.array("p_name", num(c("l_quantity"))).alias("gold_cells"), F.array(p1, num(F.floor(c("l_quantity") * (1 + c("l_tax") * 4)))).alias("pred_cells"))
    return ev.field_outcomes(pairs, ["Compound", "Activity data"])


@query("d16_anchor_faithfulness", sql(f"""SELECT 'Q1' AS question_id, CAST(count(*) FILTER (row_index % 11 <> 3 AND trim(w1 || w2) <> '') * 2 AS BIGINT) AS supported, CAST(sum(CASE WHEN row_index % 11 = 3 THEN 1 ELSE 2 END) AS BIGINT) AS total,
    {ratio_sql("count(*) FILTER (row_index % 11 <> 3 AND trim(w1 || w2) <> '') * 2", "sum(CASE WHEN row_index % 11 = 3 THEN 1 ELSE 2 END)")} AS faithfulness FROM erow""", "lines", "chunks", extra=ROWS))
def d16_anchors(spark, d):
    return ev.anchor_support(_rows(spark, d)[0].withColumn("question_id", F.lit("Q1")))


@query("j9_routing_confusion", sql(prf_sql("""(SELECT lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM
    (SELECT lang, coalesce(quality=1, FALSE) AS g, n_chars > 800 AS p FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang)""", "lang")))
def j9(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang", "n_chars")
    gold = table(spark, d, "labels", "doc_id", "quality").join(t, "doc_id").select("doc_id", "lang", (c("quality") == 1).alias("positive"))
    return rel.confusion(gold, t.select("doc_id", "lang", (c("n_chars") > 800).alias("positive")), ["doc_id", "lang"], ["lang"])


# ---- filters and joins ---------------------------------------------------------------------------
@query("p2_reportable_evidence", sql("""SELECT evidence_id, review_status, model_confidence FROM reportable ORDER BY CASE review_status WHEN 'APPROVED' THEN 0 ELSE 1 END,
    model_confidence DESC NULLS LAST, updated_at DESC, evidence_id""", "evidence", "reportable"))
def p2(spark, d):
    return rp.reportable_ordered(evidence(spark, d)).select("evidence_id", "review_status", "model_confidence")


@query("t2_nulls_last_order", sql("""SELECT evidence_id, row_number() OVER (ORDER BY CASE review_status WHEN 'APPROVED' THEN 0 ELSE 1 END, mc DESC NULLS LAST, updated_at DESC, evidence_id) AS rank
    FROM (SELECT *, CASE WHEN part_id % 4 > 0 THEN model_confidence END AS mc FROM reportable)""", "evidence", "reportable"))
def t2(spark, d):
    e = reportable(spark, d).withColumn("model_confidence", F.when(c("part_id") % 4 > 0, c("model_confidence")))
    return rp.rank_reportable(e).select("evidence_id", "rank")


@query("p3_optional_filters_with_child", """SELECT o_orderkey, o_orderstatus, o_totalprice, total FROM (SELECT *, count(*) OVER () AS total FROM orders o WHERE o_orderstatus='F'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R' AND l_quantity>40)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def p3(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    status, priority, flag, qty = "F", None, "R", 40
    li = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey")
    kept = rel.where_all(o, c("o_orderstatus") == status, None if priority is None else c("o_orderpriority") == priority)
    kept = rel.with_child(kept, li, ["o_orderkey"], c("l_returnflag") == flag, c("l_quantity") > qty)
    return rel.page(kept, [c("o_totalprice").desc(), c("o_orderkey")], 2, 50).select("o_orderkey", "o_orderstatus", "o_totalprice", "total")


@query("t3_offset_page", """SELECT o_orderkey, total FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 60""")
def t3(spark, d):
    return rel.page(table(spark, d, "orders", "o_orderkey", "o_totalprice"), [c("o_totalprice").desc(), c("o_orderkey")], 3, 20).select("o_orderkey", "total")


@query("t3_keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 25")
def t3_keyset(spark, d):
    return rel.page_after(table(spark, d, "orders", "o_orderkey"), "o_orderkey", 700, 25)


@query("p4_name_search", """SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), '#2')""")
def p4(spark, d):
    e = table(spark, d, "part").select("p_partkey", c("p_name").alias("canonical_name"), c("p_brand").alias("normalized_key"), F.array("p_type", "p_brand").alias("aliases"))
    return rel.search_names(e, " RING").unionByName(rel.search_names(e, "#2")).select("p_partkey").distinct()


@query("p5_json_predicate", r"""SELECT user_id, k, count(*) AS n FROM (SELECT user_id, CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(x AS INT) ELSE 2147483647 END AS k FROM
    (SELECT user_id, CASE WHEN event_id % 10 = 0 THEN 'x' || json_extract_string(props, '$.k') ELSE json_extract_string(props, '$.k') END AS x FROM events)) WHERE k >= 50 GROUP BY ALL""")
def p5(spark, d):
    x = F.get_json_object("props", "$.k")
    t = table(spark, d, "events", "event_id", "user_id", "props").select("user_id", rel.digits_or_max(F.when(c("event_id") % 10 == 0, F.concat(F.lit("x"), x)).otherwise(x)).alias("k"))
    return t.where("k >= 50").groupBy("user_id", "k").agg(F.count("*").alias("n"))


@query("p6_membership_filter", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def p6(spark, d):
    return table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id"), "doc_id", "left_semi")


@query("j4_not_yet_judged", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4(spark, d):
    return table(spark, d, "documents", "doc_id").join(table(spark, d, "labels", "doc_id"), "doc_id", "left_anti")


@query("j1_evidence_with_document", """SELECT o_orderpriority, l_returnflag, count(*) AS n_rows, count(DISTINCT l_orderkey) AS documents, """ + r_sql("avg(l_discount*10)") + """ AS confidence
    FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN part ON p_partkey=l_partkey GROUP BY ALL""")
def j1(spark, d):
    e = evidence(spark, d)
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return e.join(o, e.document_id == o.o_orderkey).groupBy("o_orderpriority", c("assay_method").alias("l_returnflag")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("document_id").alias("documents"), round_half_up(F.avg("model_confidence")).alias("confidence"))


@query("j2_left_outer_twice", """SELECT c_custkey, n_name, o_orderkey FROM customer LEFT JOIN nation ON n_nationkey=c_nationkey AND n_regionkey=1 LEFT JOIN orders ON o_custkey=c_custkey AND o_orderstatus='P'""")
def j2(spark, d):
    cu = table(spark, d, "customer", "c_custkey", "c_nationkey")
    n = table(spark, d, "nation").where("n_regionkey = 1")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'")
    return cu.join(n, cu.c_nationkey == n.n_nationkey, "left").join(o, cu.c_custkey == o.o_custkey, "left").select("c_custkey", "n_name", "o_orderkey")


@query("j3_alternative_keys_best_row", """SELECT o_orderkey, c_custkey, c_acctbal FROM (SELECT o_orderkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY o_orderkey ORDER BY c_acctbal DESC, c_custkey DESC) AS n
    FROM orders JOIN customer ON c_custkey=o_custkey OR c_name = 'Customer#' || lpad((o_custkey+7)::VARCHAR, 9, '0')) WHERE n=1""")
def j3(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", c("o_custkey").cast("string").alias("k1"),
        F.concat(F.lit("Customer#"), F.lpad((c("o_custkey") + 7).cast("string"), 9, "0")).alias("k2"))
    cu = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").select("c_custkey", "c_acctbal", c("c_custkey").cast("string").alias("id_key"),
        F.substring_index(F.concat(F.lit("data/in/"), c("c_name")), "/", -1).alias("file_key"))
    return rel.best_match(o, cu, [("k1", "id_key"), ("k2", "file_key")], "o_orderkey", ["c_acctbal", "c_custkey"], ["c_custkey", "c_acctbal"])


@query("j10_neighbour_pages", """SELECT conv_id, turn FROM conversations x WHERE EXISTS (SELECT 1 FROM conversations y WHERE y.conv_id=x.conv_id AND y.role='system' AND abs(y.turn-x.turn)<=2)""")
def j10(spark, d):
    t = table(spark, d, "conversations", "conv_id", "turn", "role")
    return rel.neighbours(t, t.where("role = 'system'"), 2, "conv_id", "turn").select("conv_id", "turn")


RES = """req AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000000 END AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE sha256(text) END AS sha FROM documents),
 dsha AS (SELECT doc_id AS document_id, sha256(text) AS sha FROM documents),
 res AS (SELECT request_id, coalesce(a.document_id, b.m) AS resolved_id, CASE WHEN a.document_id IS NOT NULL THEN 'ID' WHEN b.m IS NOT NULL THEN 'HASH' END AS resolved_by FROM req
    LEFT JOIN dsha a ON a.document_id=req.document_id LEFT JOIN (SELECT sha, min(document_id) AS m FROM dsha GROUP BY sha) b ON b.sha=req.sha)"""


def _resolve(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").select(c("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha"))
    req = t.select(c("document_id").alias("request_id"), F.when(c("document_id") % 2 == 0, c("document_id")).otherwise(c("document_id") + 1000000000).alias("document_id"),
                   F.when(c("document_id") % 5 == 0, "none").otherwise(c("sha")).alias("sha"))
    return rel.by_id_else_hash(req, t)


@query("j11_id_else_hash", sql("SELECT * FROM res WHERE resolved_id IS NOT NULL", extra=RES))
def j11(spark, d):
    return _resolve(spark, d)[0]


@query("j11_unresolved", sql("SELECT request_id FROM res WHERE resolved_id IS NULL", extra=RES))
def j11_unresolved(spark, d):
    return _resolve(spark, d)[1]


# ---- nested observations -------------------------------------------------------------------------
def _bundles(spark, d, legacy: bool):
    """One bundle per part: an efficacy experiment per organism with a test and a control group, and a safety experiment."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    k, size = c("p_partkey"), c("p_size").cast("double")
    value = F.when(k % 10 == 0, size + 1).otherwise(size) if legacy else size
    unit = F.lit("mg/ml") if legacy else F.when(k % 4 == 0, "mg/ml").otherwise("ug/ml")
    rel_ = F.when(k % 7 == 0, "GT").otherwise("EQ") if not legacy else F.lit("EQ")
    obs = F.struct(value.alias("value"), rel_.alias("relation"), unit.alias("unit"))
    group = lambda role, m: F.struct(F.lit(role).alias("role"), m.alias("material_id"), F.array(obs).alias("observations"))
    exp = lambda domain, target, groups: F.struct(F.lit(domain).alias("domain"), target.alias("target"), F.array(*groups).alias("groups"))
    safety = F.when(k % 3 == 0, F.array(exp("SAFETY", F.lit("cells"), [group("TEST", c("p_name"))])))
    eff = F.array(exp("EFFICACY", c("p_type"), [group("TEST", c("p_name")), group("POSITIVE_CONTROL", F.lit("control"))]))
    t = p if legacy else p.where("p_size <> 9")
    return t.select(k.alias("bundle_id"), F.when(k % 3 == 0, F.concat(eff, safety)).otherwise(eff).alias("experiments"))


@query("a20_bundle_metrics", """SELECT p_partkey AS bundle_id, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS experiments, 1 AS efficacy_experiments, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS observations,
    CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS test_observations, 1 AS control_observations FROM part WHERE p_size <> 9""")
def a20(spark, d):
    return ev.bundle_metrics(_bundles(spark, d, False))


@query("j14_observation_reconcile", """SELECT p_partkey AS bundle_id, p_name AS material_id, p_type AS target, p_size <> 9 AND p_partkey % 10 <> 0 AS numeric_match, p_size <> 9 AND p_partkey % 7 <> 0 AS relation_match,
    p_size <> 9 AND p_partkey % 4 <> 0 AS unit_correction_required FROM part""")
def j14(spark, d):
    return ev.reconcile(ev.observations(_bundles(spark, d, False)), ev.observations(_bundles(spark, d, True)))


@query("j14_reconcile_summary", f"""SELECT *, {ratio_sql('numeric_matches', 'shared')} AS numeric_match_rate FROM (SELECT count(*) AS shared, count(*) FILTER (p_size <> 9 AND p_partkey % 10 <> 0) AS numeric_matches,
    count(*) FILTER (p_size <> 9 AND p_partkey % 7 <> 0) AS relation_matches, count(*) FILTER (p_size <> 9 AND p_partkey % 4 <> 0) AS unit_corrections FROM part)""")
def j14_summary(spark, d):
    return ev.reconcile_summary(j14(spark, d))


@query("j15_claim_provenance", """SELECT claim_id, CAST(n AS INT) AS literature_no, count(DISTINCT s_suppkey) AS evidence_rows, count(DISTINCT s_suppkey || ':' || ch) AS chunks FROM
    (SELECT DISTINCT o_orderkey AS claim_id, unnest([o_orderkey % 9, o_custkey % 9]) AS n FROM orders) JOIN (SELECT s_suppkey, s_suppkey % 9 AS n2 FROM supplier) ON n2 = n, (SELECT unnest([0, 1]) AS ch) WHERE n > 0 GROUP BY ALL""")
def j15(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    tag = lambda x: F.concat(F.lit("[文献"), (x % 9).cast("string"), F.lit("]"))
    claims = o.select(c("o_orderkey").alias("claim_id"), F.lit(1).alias("report_id"), F.concat(F.lit("seen "), tag(c("o_orderkey")), F.lit(" and "), tag(c("o_custkey"))).alias("text"))
    s = table(spark, d, "supplier", "s_suppkey")
    e = s.where("s_suppkey % 9 > 0").select(F.lit(1).alias("report_id"), (c("s_suppkey") % 9).cast("int").alias("literature_no"), c("s_suppkey").alias("evidence_id"), c("s_suppkey").alias("document_id"))
    ch = s.select(c("s_suppkey").alias("document_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("document_id", F.concat_ws(":", "document_id", "i").alias("chunk_id"))
    return ev.claim_provenance_counts(claims, e, ch)
