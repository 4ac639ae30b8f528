"""Dedup, screening, cohorts and keyed-table queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from litquarry.functions.core import md5_order, round_half_up
from litquarry.operators import corpus as cp, relational as rel
from litquarry.plans.registry import query
from litquarry.plans.views import chunks, docs, labelled, r_sql, ratio_sql, sql
from litquarry.sources.tables import table

c = F.col

# content hashes repeat where texts repeat; a DOI is shared inside small groups of neighbouring ids
DEDUP_IN = """dd AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || (doc_id // 9) END AS doi,
    sha256(text) AS sha FROM documents)"""


def _dedup_in(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select(
        c("doc_id").alias("document_id"),
        F.when(c("doc_id") % 3 == 0, F.concat(F.lit("10.1000/"), F.floor(c("doc_id") / 9).cast("string"))).alias("doi"),
        F.sha2("text", 256).alias("sha"))


# the scan needs recursion in SQL, so the oracle removes rows round by round to a fixed depth that covers this data
def greedy_sql(src: str, keys: list[str], rounds: int) -> str:
    out, prev = [], src
    for i in range(rounds):
        mins = ", ".join(f"min(document_id) FILTER ({k} IS NOT NULL) OVER (PARTITION BY {k}) AS m_{k}" for k in keys)
        free = " AND ".join(f"({k} IS NULL OR m_{k} = document_id)" for k in keys)
        out.append(f"k{i} AS (SELECT * EXCLUDE ({', '.join('m_' + k for k in keys)}) FROM (SELECT *, {mins} FROM {prev}) WHERE {free})")
        gone = " AND ".join(f"({k} IS NULL OR {k} NOT IN (SELECT {k} FROM k{i} WHERE {k} IS NOT NULL))" for k in keys)
        out.append(f"u{i} AS (SELECT * FROM {prev} WHERE document_id NOT IN (SELECT document_id FROM k{i}) AND {gone})")
        prev = f"u{i}"
    out.append("canon AS (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(rounds)) + ")")
    return ",\n".join(out)


@query("d1_canonical_dedup", sql("""SELECT document_id, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi ELSE 'sha256:' || sha END AS own_key,
    CASE WHEN document_id IN (SELECT document_id FROM canon) THEN NULL ELSE coalesce(a, b) END AS duplicate_of,
    CASE WHEN document_id IN (SELECT document_id FROM canon) THEN NULL WHEN a IS NOT NULL THEN 'DOI' ELSE 'CONTENT_SHA256' END AS reason
    FROM (SELECT dd.*, (SELECT max(document_id) FROM canon x WHERE x.doi = dd.doi AND x.document_id < dd.document_id) AS a,
      (SELECT max(document_id) FROM canon x WHERE x.sha = dd.sha AND x.document_id < dd.document_id) AS b FROM dd)""",
    extra=DEDUP_IN + ",\n" + greedy_sql("dd", ["doi", "sha"], 6)))
def d1(spark, d):
    return cp.dedup(_dedup_in(spark, d))


PREP_IN = """pr AS (SELECT doc_id // 2 * 2 AS rid, doc_id AS line_no, doc_id AS document_id0, title, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END AS abstract,
    CASE WHEN doc_id % 5 = 0 THEN '10.1000/' || (doc_id // 25) END AS doi, CASE WHEN doc_id % 23 = 0 THEN 'x1' END AS declared,
    CASE WHEN doc_id % 29 = 0 THEN 'READ_ERROR' END AS err FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM documents)),
 pk AS (SELECT line_no AS document_id, CASE WHEN line_no % 40 < 2 THEN rid ELSE line_no END AS id, doi, lower(trim(title)) || chr(31) ||
    lower(trim(regexp_replace(abstract, '\\s+', ' ', 'g'))) AS tk, abstract, declared, err FROM pr),
 able AS (SELECT document_id, id, doi, tk FROM pk WHERE declared IS NULL AND err IS NULL AND trim(abstract) <> '')"""


def _records(spark, d):
    t = docs(spark, d)
    n = c("document_id")
    return t.select(
        F.when(n % 40 < 2, F.floor(n / 2) * 2).otherwise(n).alias("document_id"), n.alias("line_no"), "title",
        F.when(n % 17 == 0, " ").otherwise(c("text")).alias("abstract"),
        F.when(n % 5 == 0, F.concat(F.lit("10.1000/"), F.floor(n / 25).cast("string"))).alias("doi"),
        F.when(n % 23 == 0, "x1").alias("declared_duplicate_of"), F.when(n % 29 == 0, "READ_ERROR").alias("input_error"))


# ids run with the line numbers here, so line order equals (id, line) order
PREP_STATUS = """prep AS (SELECT id AS document_id, document_id AS line_no, CASE WHEN ia IS NOT NULL THEN 'DUPLICATE_ID' WHEN dup IS NOT NULL THEN 'DUPLICATE'
    WHEN err IS NOT NULL THEN err WHEN trim(abstract) = '' THEN 'MISSING_ABSTRACT' ELSE 'READY' END AS status, dup FROM (SELECT *, coalesce(declared, ib::VARCHAR, ic::VARCHAR) AS dup FROM
    (SELECT pk.*, (SELECT max(id) FROM canon x WHERE x.id = pk.id AND x.document_id < pk.document_id) AS ia,
     (SELECT max(id) FROM canon x WHERE x.doi = pk.doi AND x.document_id < pk.document_id) AS ib,
     (SELECT max(id) FROM canon x WHERE x.tk = pk.tk AND x.document_id < pk.document_id) AS ic FROM pk)))"""
PREP = PREP_IN + ",\n" + greedy_sql("able", ["id", "doi", "tk"], 6) + ",\n" + PREP_STATUS


@query("d2_corpus_prepare", sql("""SELECT document_id, line_no, status, CASE WHEN status='DUPLICATE' THEN dup END AS duplicate_of FROM prep""", extra=PREP))
def d2(spark, d):
    return cp.prepare_corpus(_records(spark, d)).drop("content_hash")


@query("d2_seeded_selection", sql("""SELECT document_id, line_no, CASE WHEN status <> 'READY' THEN status WHEN row_number() OVER (PARTITION BY status ORDER BY
    md5('42:' || document_id), document_id) <= 100 THEN 'SELECTED' ELSE 'NOT_SELECTED' END AS status FROM prep""", extra=PREP))
def d2_sample(spark, d):
    return cp.seeded_selection(d2(spark, d), 100, md5_order("document_id", 42)).select("document_id", "line_no", "status")


@query("a23_exclusion_counts", sql("SELECT status, count(*) AS n FROM prep WHERE status <> 'READY' GROUP BY status", extra=PREP))
def a23(spark, d):
    return cp.exclusion_counts(d2(spark, d))


QUALITY = f"""q0 AS (SELECT document_id, length(text) AS chars, length(text) - length(translate(text, '�?', '')) AS bad,
    CASE WHEN length(trim(text, E' \\t\\r\\n')) < 20 THEN 1 ELSE 0 END AS short FROM chunks),
 ql AS (SELECT document_id, count(*) AS chunk_count, CAST(sum(chars) AS BIGINT) AS total_chars, sum(bad) AS bad, sum(short) AS short, count(*) AS lines FROM q0 GROUP BY ALL),
 quality AS (SELECT document_id, chunk_count, total_chars, {ratio_sql('total_chars', 'chunk_count')} AS average_chunk_chars,
    {ratio_sql('bad', 'total_chars')} AS replacement_ratio, {ratio_sql('short', 'lines')} AS short_line_ratio FROM ql)"""


@query("a18_text_quality", sql("SELECT * FROM quality", "lines", "chunks", extra=QUALITY))
def a18(spark, d):
    return cp.text_quality(chunks(spark, d))


META = """meta AS (SELECT doc_id AS document_id, CASE WHEN source = 'src3' THEN ' ' ELSE split_part(text, chr(10), 1) END AS title,
    CASE WHEN source IN ('src3', 'src5') THEN NULL WHEN source = 'src7' THEN '' ELSE split_part(text, chr(10), 2) END AS abstract FROM documents)"""
GATE = """gate AS (SELECT m.*, coalesce(chunk_count, 0) AS chunk_count, coalesce(total_chars, 0) AS total_chars, fails,
    trim(coalesce(title, '')) <> '' OR trim(coalesce(abstract, '')) <> '' OR coalesce(total_chars, 0) > 0 AS usable FROM meta m LEFT JOIN
    (SELECT *, CASE WHEN chunk_count < 3 THEN 'LOW_CHUNK_COUNT' WHEN total_chars < 1500 THEN 'LOW_TEXT_COVERAGE' WHEN replacement_ratio > 0.03
     THEN 'HIGH_GARBLED_TEXT_RATIO' WHEN short_line_ratio > 0.8 THEN 'HIGH_SHORT_LINE_RATIO' END AS fails FROM quality) USING (document_id)),
 gated AS (SELECT *, CASE WHEN fails IS NULL THEN 'FULL_TEXT_READY' WHEN usable THEN 'METADATA_READY' ELSE 'UNUSABLE' END AS quality_status FROM gate)"""


def _meta(spark, d):
    t = table(spark, d, "documents", "doc_id", "source", "text")
    line = lambda n: F.split_part(c("text"), F.lit("\n"), F.lit(n))
    return t.select(c("doc_id").alias("document_id"), F.when(c("source") == "src3", " ").otherwise(line(1)).alias("title"),
                    F.when(c("source").isin("src3", "src5"), F.lit(None)).when(c("source") == "src7", "").otherwise(line(2)).alias("abstract"))


def _gated(spark, d):
    return cp.quality_gate(_meta(spark, d), cp.text_quality(chunks(spark, d)))


@query("d4_quality_gate", sql("""SELECT document_id, CASE WHEN fails IS NULL THEN 'PASS' ELSE 'REJECT' END AS quality_decision, quality_status,
    CASE WHEN fails IS NULL THEN '' WHEN usable THEN fails ELSE 'MISSING_USABLE_CONTENT' END AS quality_reason FROM gated""",
    "lines", "chunks", extra=",\n".join([QUALITY, META, GATE])))
def d4(spark, d):
    return _gated(spark, d).select("document_id", "quality_decision", "quality_status", "quality_reason")


SCREEN = """scr AS (SELECT *, CASE WHEN quality_status='UNUSABLE' THEN 'NO_METADATA' WHEN trim(coalesce(abstract,''))='' THEN 'TITLE_ONLY'
    WHEN trim(coalesce(title,''))='' THEN 'ABSTRACT_ONLY' ELSE 'TITLE_AND_ABSTRACT' END AS relevance_source FROM gated LEFT JOIN labelled USING (document_id)),
 scr2 AS (SELECT *, CASE relevance_source WHEN 'NO_METADATA' THEN 'NOT_EVALUATED' WHEN 'TITLE_ONLY' THEN 'POTENTIALLY_RELEVANT' ELSE
    CASE WHEN label='RELEVANT' THEN 'RELEVANT' WHEN label='DISTRACTOR' AND relevance_source='TITLE_AND_ABSTRACT' THEN 'NOT_RELEVANT' ELSE 'POTENTIALLY_RELEVANT' END END AS relevance FROM scr),
 screened AS (SELECT *, CASE WHEN quality_status='UNUSABLE' THEN 'SKIPPED' WHEN relevance='NOT_RELEVANT' THEN 'REJECTED' ELSE 'ACCEPTED' END AS final_decision FROM scr2)"""
SCREEN_ALL = ",\n".join([QUALITY, META, GATE, SCREEN])


def _screened(spark, d):
    lab = labelled(spark, d).select("document_id", F.when(c("label") == "DISTRACTOR", "NOT_RELEVANT").when(
        c("label") == "IRRELEVANT", "POTENTIALLY_RELEVANT").otherwise(c("label")).alias("screening_label"))
    return cp.screening(_gated(spark, d), lab)


@query("d5_screening_decision", sql("""SELECT document_id, relevance_source, relevance, final_decision, CASE WHEN final_decision='REJECTED'
    THEN 'LABEL_NOT_RELEVANT' ELSE '' END AS reject_reason FROM screened""", "lines", "chunks", "labelled", extra=SCREEN_ALL))
def d5(spark, d):
    return _screened(spark, d).select("document_id", "relevance_source", "relevance", "final_decision", "reject_reason")


COHORT_SQL = """coh AS (SELECT 'accepted' AS cohort, document_id FROM screened WHERE final_decision='ACCEPTED' UNION ALL
    SELECT 'rejected', document_id FROM screened WHERE final_decision='REJECTED' UNION ALL
    SELECT 'abstract-analysis', document_id FROM screened WHERE final_decision='ACCEPTED' AND relevance_source IN ('TITLE_AND_ABSTRACT','ABSTRACT_ONLY') UNION ALL
    SELECT 'full-text-evidence', document_id FROM screened WHERE final_decision='ACCEPTED' AND quality_status='FULL_TEXT_READY')"""


@query("d5_screening_cohorts", sql("SELECT * FROM coh", "lines", "chunks", "labelled", extra=SCREEN_ALL + ",\n" + COHORT_SQL))
def d5_cohorts(spark, d):
    return cp.screening_cohorts(_screened(spark, d))


OLD = "old AS (SELECT 'accepted' AS cohort, doc_id AS document_id FROM documents WHERE lang='en' UNION ALL SELECT 'manual', doc_id FROM documents WHERE lang='fr')"


@query("d6_cohort_publish", sql("""SELECT cohort, document_id, row_number() OVER (PARTITION BY cohort ORDER BY document_id) AS ordinal FROM
    (SELECT * FROM old WHERE cohort NOT IN (SELECT cohort FROM coh) UNION ALL SELECT * FROM coh)""", "lines", "chunks", "labelled",
    extra=",\n".join([SCREEN_ALL, COHORT_SQL, OLD])))
def d6(spark, d):
    """Screening cohorts replace older ones of the same name; ordinals are distributed ranks."""
    from litquarry.scale import global_rank
    t = table(spark, d, "documents", "doc_id", "lang")
    old = t.where("lang IN ('en', 'fr')").select(
        F.when(c("lang") == "en", "accepted").otherwise("manual").alias("cohort"), c("doc_id").alias("document_id"))
    merged = cp.replace_cohorts(old, cp.screening_cohorts(_screened(spark, d)))
    return global_rank(merged, ["cohort"], [c("document_id").asc()], "ordinal")


@query("a22_cohort_hash", """WITH m AS (SELECT o_orderpriority AS cohort, o_orderkey AS v, row_number() OVER (PARTITION BY o_orderpriority
      ORDER BY o_totalprice, o_orderkey) AS n FROM orders),
    b AS (SELECT cohort, (n-1)//10000 AS b, sha256(string_agg(v::VARCHAR, chr(10) ORDER BY n)) AS h FROM m GROUP BY ALL)
    SELECT cohort, sha256(string_agg(h, chr(10) ORDER BY b)) AS input_hash FROM b GROUP BY cohort""")
def a22(spark, d):
    from litquarry.scale import global_rank
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").select(
        c("o_orderpriority").alias("cohort"), c("o_orderkey").alias("document_id"), "o_totalprice")
    return cp.cohort_hash(global_rank(o, ["cohort"], [c("o_totalprice").asc(), c("document_id").asc()], "ordinal"))


@query("d6_supported_cohorts", """SELECT o_orderpriority AS question_id, o_custkey AS document_id, row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY o_custkey) AS ordinal FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders WHERE o_orderstatus='F')""")
def d6_supported(spark, d):
    from litquarry.scale import global_rank
    m = table(spark, d, "orders", "o_orderpriority", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'").select(
        c("o_orderpriority").alias("question_id"), c("o_custkey").alias("document_id")).distinct()
    return global_rank(m, ["question_id"], [c("document_id").asc()], "ordinal")


DELTA = """delta AS (SELECT c_custkey + 500 AS c_custkey, c_name || '#' AS c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal AS ord FROM customer
    UNION ALL SELECT c_custkey + 500, c_name || '##', c_nationkey, c_acctbal, c_mktsegment, c_acctbal + 1 FROM customer WHERE c_nationkey < 9)"""


def _delta(spark, d):
    cu = table(spark, d, "customer")
    shift = lambda df, mark, plus: df.withColumn("ord", c("c_acctbal") + plus).withColumn(
        "c_custkey", c("c_custkey") + 500).withColumn("c_name", F.concat(c("c_name"), F.lit(mark)))
    return cu, shift(cu, "#", 0).unionByName(shift(cu.where("c_nationkey < 9"), "##", 1))


@query("s11_upsert", sql("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM delta) UNION ALL
    SELECT c_custkey, c_name, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ord DESC) AS n FROM delta) WHERE n=1""", extra=DELTA))
def s11(spark, d):
    base, delta = _delta(spark, d)
    return cp.upsert(base, delta, ["c_custkey"], ["ord"]).select("c_custkey", "c_name", "c_acctbal")


@query("s11_insert_absent", sql("""SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal FROM
    (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ord) AS n FROM delta) WHERE n=1 AND c_custkey NOT IN (SELECT c_custkey FROM customer)""", extra=DELTA))
def s11_insert(spark, d):
    base, delta = _delta(spark, d)
    return cp.insert_absent(base, delta, ["c_custkey"], ["ord"]).select("c_custkey", "c_name", "c_acctbal")


@query("s12_batch_import_report", sql("""SELECT source AS batch_id, count(*) AS processed, count(*) FILTER (st='COMPLETED') AS completed,
    count(*) FILTER (st='DUPLICATE_SKIPPED') AS duplicates, count(*) FILTER (st='FAILED') AS failed, CAST(sum(n_chars) AS BIGINT) AS chars,
    CASE WHEN count(*) FILTER (st='FAILED')=0 THEN 'COMPLETED' WHEN count(*) FILTER (st<>'FAILED')=0 THEN 'FAILED' ELSE 'PARTIAL_FAILED' END AS status
    FROM (SELECT source, n_chars, CASE WHEN length(text) < 60 THEN 'FAILED' WHEN doc_id > (SELECT min(doc_id) FROM documents y WHERE y.text = x.text)
    THEN 'DUPLICATE_SKIPPED' ELSE 'COMPLETED' END AS st FROM documents x) GROUP BY source"""))
def s12(spark, d):
    t = table(spark, d, "documents", "doc_id", "source", "n_chars", "text").withColumn("sha", F.sha2("text", 256))
    first = t.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    out = t.join(first, "sha").withColumn("status", F.when(F.length("text") < 60, "FAILED").when(
        c("doc_id") > c("first_id"), "DUPLICATE_SKIPPED").otherwise("COMPLETED"))
    return rel.batch_report(out.select(c("source").alias("batch_id"), "status", c("n_chars").alias("chars")), ["chars"])


@query("p1_canonical_completed", sql("""SELECT document_id FROM dd WHERE document_id IN (SELECT document_id FROM canon)
    AND document_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')""", extra=DEDUP_IN + ",\n" + greedy_sql("dd", ["doi", "sha"], 6)))
def p1(spark, d):
    status = table(spark, d, "documents", "doc_id", "lang").select(
        c("doc_id").alias("document_id"), F.when(c("lang") == "de", "FAILED").otherwise("COMPLETED").alias("status"))
    return rel.canonical_completed(d1(spark, d).join(status, "document_id")).select("document_id")


@query("d26_vector_gc", sql("""SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT document_id FROM screened WHERE final_decision='REJECTED')""",
    "lines", "chunks", "labelled", extra=SCREEN_ALL))
def d26(spark, d):
    kept, _ = rel.collect_garbage(table(spark, d, "embeddings", "vec_id"), "vec_id",
                                  _screened(spark, d).where("final_decision = 'REJECTED'"), "document_id")
    return kept


@query("d26_vector_gc_dry_run", sql("""SELECT count(DISTINCT document_id) AS documents, count(vec_id) AS vectors FROM screened LEFT JOIN embeddings
    ON vec_id = document_id WHERE final_decision='REJECTED'""", "lines", "chunks", "labelled", extra=SCREEN_ALL))
def d26_dry(spark, d):
    _, report = rel.collect_garbage(table(spark, d, "embeddings", "vec_id"), "vec_id",
                                    _screened(spark, d).where("final_decision = 'REJECTED'"), "document_id")
    return report
