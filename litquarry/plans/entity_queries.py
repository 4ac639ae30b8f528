"""Entity, graph and query-expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions.core import round_half_up, tokens
from litquarry.operators import corpus as cp, entity as en, expansion as ex, fusion, ir_metrics as ir, retrieval as rt
from litquarry.plans import retrieval_queries as rq
from litquarry.plans.registry import query
from litquarry.plans.views import chunks, docs, labelled, questions, r_sql, sql, sub_queries, tok
from litquarry.sources.tables import table

c = F.col

# ---- vocabulary from the words of the questions --------------------------------------------------
VOCAB = f"""vw AS (SELECT DISTINCT w FROM (SELECT unnest({tok('text')}) AS w FROM benchmark) WHERE length(w) >= 7),
 vocab AS (SELECT w AS alias, left(w, 5) AS canonical, min(CASE length(w) % 3 WHEN 0 THEN 'SPECIES' WHEN 1 THEN 'PROCESS' ELSE 'STAGE' END) OVER (PARTITION BY left(w, 5)) AS category FROM vw)"""


def _vocab(spark, d):
    w = table(spark, d, "benchmark", "text").select(F.explode(tokens("text")).alias("alias")).where(F.length("alias") >= 7).distinct()
    v = w.withColumn("canonical", F.left("alias", F.lit(5)))
    k = F.length("alias") % 3
    cat = v.groupBy("canonical").agg(F.min(F.when(k == 0, "SPECIES").when(k == 1, "PROCESS").otherwise("STAGE")).alias("category"))
    return v.join(cat, "canonical").select("alias", "canonical", "category")


@query("j7_dictionary_substring", sql("""SELECT DISTINCT document_id, canonical, category, alias FROM docs, vocab WHERE contains(lower(text), alias)""", "docs", extra=VOCAB))
def j7(spark, d):
    return en.find_terms(docs(spark, d), ["document_id"], "text", _vocab(spark, d))


WORDS = f"""dw AS (SELECT DISTINCT document_id, chunk_id, unnest({tok('text')}) AS alias FROM chunks), hit AS (SELECT document_id, chunk_id, canonical, category, alias FROM dw JOIN vocab USING (alias))"""


@query("j7_dictionary_whole_words", sql("SELECT * FROM hit", "lines", "chunks", extra=VOCAB + ",\n" + WORDS))
def j7_words(spark, d):
    return en.find_words(chunks(spark, d), ["document_id", "chunk_id"], "text", _vocab(spark, d), 2)


# ---- mentions from the star schema: compounds and organisms --------------------------------------
MEN = """lp AS (SELECT l_orderkey, l_linenumber, l_discount, l_quantity, l_returnflag, p_name, p_brand, p_type, s_name FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey),
 men AS (SELECT l_orderkey AS document_id, replace(p_name, ' ', '_') AS normalized_key, 'COMPOUND' AS entity_type, CASE WHEN l_linenumber % 2 = 0 THEN p_name || ' (' || p_type || ')' ELSE p_name END AS canonical_name, l_discount * 10 AS confidence,
    p_brand AS alias, l_orderkey || ':' || l_linenumber AS chunk_id, p_name || ' with ' || s_name AS evidence_text, l_returnflag AS flag FROM lp UNION ALL
    SELECT l_orderkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), 'ORGANISM', s_name, l_discount * 10, l_returnflag, l_orderkey || ':' || l_linenumber, p_name || ' with ' || s_name, l_returnflag FROM lp)"""


def _lp(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_quantity", "l_returnflag")
    return li.join(table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type"), c("l_partkey") == c("p_partkey")).join(
        table(spark, d, "supplier", "s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"))


def _mentions(spark, d):
    from litquarry.functions.identifiers import key_normalise
    lp = _lp(spark, d)
    text = F.concat_ws(" ", "p_name", F.lit("with"), "s_name")
    name = F.when(c("l_linenumber") % 2 == 0, F.concat(c("p_name"), F.lit(" ("), c("p_type"), F.lit(")"))).otherwise(c("p_name"))
    chunk = F.concat_ws(":", "l_orderkey", "l_linenumber")
    two = F.array(F.struct(key_normalise("p_name").alias("normalized_key"), F.lit("COMPOUND").alias("entity_type"), name.alias("canonical_name"), c("p_brand").alias("alias")),
                  F.struct(key_normalise("s_name").alias("normalized_key"), F.lit("ORGANISM").alias("entity_type"), c("s_name").alias("canonical_name"), c("l_returnflag").alias("alias")))
    return lp.select(c("l_orderkey").alias("document_id"), (c("l_discount") * 10).alias("confidence"), chunk.alias("chunk_id"), text.alias("evidence_text"),
                     c("l_returnflag").alias("flag"), F.explode(two).alias("x")).select("document_id", "confidence", "chunk_id", "evidence_text", "flag", "x.*")


@query("p9_confidence_threshold", sql("SELECT entity_type, normalized_key, count(*) AS n FROM men WHERE confidence >= 0.6 GROUP BY ALL", extra=MEN))
def p9(spark, d):
    return en.confident(_mentions(spark, d)).groupBy("entity_type", "normalized_key").agg(F.count("*").alias("n"))


@query("a11_mention_merge", sql("""SELECT document_id, normalized_key, entity_type, max_by(canonical_name, (length(canonical_name), canonical_name)) AS canonical_name, max(confidence) AS confidence, count(*) AS mentions FROM men GROUP BY ALL""", extra=MEN))
def a11(spark, d):
    return en.merge_mentions(_mentions(spark, d))[0]


@query("a11_mention_lists", sql("""SELECT kind, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (SELECT DISTINCT document_id, normalized_key, entity_type, unnest(['alias','chunk','evidence']) AS kind, unnest([alias, chunk_id, evidence_text]) AS value FROM men) GROUP BY kind""", extra=MEN))
def a11_lists(spark, d):
    return en.merge_mentions(_mentions(spark, d))[1].groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


REL = """rel AS (SELECT l_orderkey AS document_id, 'COMPOUND|' || replace(p_name, ' ', '_') AS head, CASE l_returnflag WHEN 'R' THEN 'EVALUATED_BY' ELSE 'HAS_ACTIVITY_AGAINST' END AS relation_type, 'ORGANISM|' || regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') AS tail,
    l_discount * 10 AS confidence, l_orderkey || ':' || l_linenumber AS chunk_id, p_name || ' with ' || s_name AS evidence_text FROM lp)"""


def _relations(spark, d):
    from litquarry.functions.identifiers import key_normalise
    lp = _lp(spark, d)
    return lp.select(c("l_orderkey").alias("document_id"), F.concat(F.lit("COMPOUND|"), key_normalise("p_name")).alias("head"),
                     F.when(c("l_returnflag") == "R", "EVALUATED_BY").otherwise("HAS_ACTIVITY_AGAINST").alias("relation_type"), F.concat(F.lit("ORGANISM|"), key_normalise("s_name")).alias("tail"),
                     (c("l_discount") * 10).alias("confidence"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"), F.concat_ws(" ", "p_name", F.lit("with"), "s_name").alias("evidence_text"))


@query("a12_relation_merge", sql("SELECT head, relation_type, tail, max(confidence) AS confidence, count(DISTINCT chunk_id) AS chunks, count(DISTINCT evidence_text) AS quotes FROM rel GROUP BY ALL", extra=MEN + ",\n" + REL))
def a12(spark, d):
    return en.merge_relations(_relations(spark, d))


@query("a13_document_entity_merge", """WITH b AS (SELECT l_suppkey AS document_id, l_linenumber AS batch_no, p_type AS entity_type, p_brand AS normalized_key, CASE WHEN l_linenumber = 1 THEN ' ' ELSE p_name END AS name, l_tax AS confidence FROM lineitem JOIN part ON p_partkey=l_partkey)
    SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY entity_type, name, normalized_key) AS position FROM (SELECT document_id, entity_type, normalized_key, min_by(name, (batch_no, name)) FILTER (trim(name) <> '') AS name, max(confidence) AS confidence,
    count(DISTINCT batch_no) AS batches FROM b GROUP BY ALL)""".replace("ORDER BY entity_type, name,", "ORDER BY entity_type, name NULLS FIRST,"))
def a13(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_tax")
    b = li.join(table(spark, d, "part", "p_partkey", "p_type", "p_brand", "p_name"), c("l_partkey") == c("p_partkey")).select(
        c("l_suppkey").alias("document_id"), c("l_linenumber").alias("batch_no"), c("p_type").alias("entity_type"), c("p_brand").alias("normalized_key"),
        F.when(c("l_linenumber") == 1, " ").otherwise(c("p_name")).alias("name"), c("l_tax").alias("confidence"))
    return en.merge_document_entities(b)


LIB = """lib AS (SELECT DISTINCT 'COMPOUND' AS entity_type, replace(p_name, ' ', '_') AS normalized_key, upper(p_name) AS canonical_name FROM part WHERE p_name LIKE '%e%' AND p_name NOT LIKE '%ring%')"""


def _library(spark, d):
    from litquarry.functions.identifiers import key_normalise
    p = table(spark, d, "part", "p_name").where("p_name LIKE '%e%' AND p_name NOT LIKE '%ring%'").distinct()
    return p.select(F.lit("COMPOUND").alias("entity_type"), key_normalise("p_name").alias("normalized_key"), F.upper("p_name").alias("canonical_name"))


@query("j6_entity_link", sql("""SELECT p_partkey, coalesce(canonical_name, p_name) AS p_name, p_type FROM part LEFT JOIN lib ON normalized_key = replace(p_name, ' ', '_')""", extra=LIB))
def j6(spark, d):
    return en.link_entities(table(spark, d, "part", "p_partkey", "p_name", "p_type"), _library(spark, d), "p_partkey", {"p_name": "COMPOUND", "p_type": "CLASS"})[0]


@query("j6_unknown_candidates", sql("""SELECT 'COMPOUND' AS entity_type, replace(p_name, ' ', '_') AS normalized_key, p_name AS mention, count(*) AS mentions, 0.5 AS confidence FROM part WHERE replace(p_name, ' ', '_') NOT IN (SELECT normalized_key FROM lib) GROUP BY p_name UNION ALL
    SELECT 'CLASS', lower(p_type), p_type, count(*), 0.5 FROM part GROUP BY p_type""", extra=LIB))
def j6_unknown(spark, d):
    return en.link_entities(table(spark, d, "part", "p_partkey", "p_name", "p_type"), _library(spark, d), "p_partkey", {"p_name": "COMPOUND", "p_type": "CLASS"})[1]


@query("u4_alias_union", """SELECT p_partkey, p_name || '|' || p_brand || CASE WHEN p_type <> p_name THEN '|' || p_type ELSE '' END AS aliases FROM part""")
def u4(spark, d):
    a = en.union_aliases(F.array("p_name", "p_brand", F.lit(" ")), F.array(F.concat(F.lit(" "), c("p_brand")), "p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(a, "|").alias("aliases"))


@query("d12_entity_candidates", sql("""SELECT entity_type, normalized_key, max_by(canonical_name, (confidence, canonical_name)) AS canonical_name, max(confidence) AS confidence, count(DISTINCT document_id) AS documents, count(*) AS mentions FROM men
    WHERE (entity_type, normalized_key) NOT IN (SELECT entity_type, normalized_key FROM lib) GROUP BY ALL""", extra=MEN + ",\n" + LIB))
def d12(spark, d):
    return en.entity_candidates(_mentions(spark, d), _library(spark, d))


def _reviewed(spark, d):
    m = _mentions(spark, d).where("entity_type = 'COMPOUND'").select("entity_type", "normalized_key", "canonical_name", "alias", "flag").distinct()
    lib = _library(spark, d).withColumn("source_count", F.lit(1)).withColumn("aliases", F.array(F.lower("canonical_name")))
    return lib, m.withColumn("decision", F.when(c("flag") == "R", "REJECTED").otherwise("APPROVED")).drop("flag")


D12 = MEN + ",\n" + LIB + """,\n ap AS (SELECT DISTINCT entity_type, normalized_key, canonical_name, alias, flag FROM men WHERE entity_type='COMPOUND' AND flag <> 'R')"""


@query("d12_review_merge", sql("""SELECT coalesce(l.entity_type, a.entity_type) AS entity_type, coalesce(l.normalized_key, a.normalized_key) AS normalized_key, coalesce(l.canonical_name, a.nm) AS canonical_name,
    CASE WHEN l.entity_type IS NULL THEN 0 ELSE 1 END + coalesce(n, 0) AS source_count FROM lib l FULL JOIN (SELECT entity_type, normalized_key, min(canonical_name) AS nm, count(*) AS n FROM ap GROUP BY ALL) a
    ON a.entity_type=l.entity_type AND a.normalized_key=l.normalized_key""", extra=D12))
def d12_merge(spark, d):
    return en.review_merge(*_reviewed(spark, d))[0]


@query("d12_review_aliases", sql("""SELECT entity_type, normalized_key, lower(canonical_name) AS alias FROM lib UNION SELECT entity_type, normalized_key, alias FROM ap""", extra=D12))
def d12_aliases(spark, d):
    return en.review_merge(*_reviewed(spark, d))[1]


@query("d12_unique_quotes", sql("""SELECT entity_type, normalized_key, sha256(evidence_text) AS quote_hash, min(document_id) AS document_id FROM men GROUP BY ALL""", extra=MEN))
def d12_quotes(spark, d):
    return en.unique_quotes(_mentions(spark, d).withColumnRenamed("evidence_text", "quote"))


@query("d13_mention_validation", sql("""SELECT code, entity_type, count(*) AS n FROM (SELECT *, CASE WHEN l_linenumber > 6 THEN 'UNKNOWN_CHUNK' WHEN confidence > 1 THEN 'BAD_CONFIDENCE' WHEN flag = 'R' THEN 'QUOTE_NOT_IN_CHUNK'
    WHEN row_number() OVER (PARTITION BY chunk_id, normalized_key, entity_type, l_linenumber > 6 OR confidence > 1 OR flag = 'R', evidence_text ORDER BY confidence, alias, canonical_name) > 1 THEN 'DUPLICATE' END AS code
    FROM (SELECT men.*, CAST(split_part(chunk_id, ':', 2) AS INT) AS l_linenumber FROM men)) GROUP BY ALL""", extra=MEN))
def d13(spark, d):
    m = _mentions(spark, d).withColumn("mention_id", F.struct("confidence", "alias", "canonical_name")).withColumn("mention_id", F.concat_ws("|", F.lpad(c("confidence").cast("string"), 8, "0"), "alias", "canonical_name", F.monotonically_increasing_id().cast("string")))
    m = m.withColumn("evidence_text", F.when(c("flag") == "R", "~ not there ~").otherwise(c("evidence_text")))
    ch = _mentions(spark, d).where(F.substring_index("chunk_id", ":", -1).cast("int") <= 6).select("document_id", "chunk_id", "evidence_text").groupBy("document_id", "chunk_id").agg(
        F.array_join(F.array_sort(F.collect_set("evidence_text")), " ").alias("text"))
    return en.validate_mentions(m, ch).groupBy("code", "entity_type").agg(F.count("*").alias("n"))


@query("d13_graph_edges", sql("""SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (SELECT DISTINCT document_id::VARCHAR AS src, 'HAS_PASSAGE' AS type, chunk_id AS dst FROM men UNION
    SELECT entity_type || '|' || normalized_key, 'MENTIONED_IN', chunk_id FROM men UNION SELECT head, relation_type, tail FROM rel) GROUP BY type""", extra=MEN + ",\n" + REL))
def d13_edges(spark, d):
    m = _mentions(spark, d)
    ends = m.withColumn("normalized_key", F.concat_ws("|", "entity_type", "normalized_key"))
    return en.graph_tables(m, m, en.validate_relations(_relations(spark, d), ends))[1].groupBy("type").agg(
        F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


HOP = """eg AS (SELECT DISTINCT head AS src, relation_type AS type, tail AS dst FROM rel), bo AS (SELECT src AS id, dst AS neighbour, type FROM eg UNION SELECT dst, src, type FROM eg),
 hop AS (SELECT id, neighbour, type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY neighbour, type) AS n FROM bo) WHERE n <= 4)"""


def _edges(spark, d):
    return _relations(spark, d).select(c("head").alias("src"), c("relation_type").alias("type"), c("tail").alias("dst")).distinct()


@query("j12_one_hop_neighbours", sql("SELECT * FROM hop", extra=MEN + ",\n" + REL + ",\n" + HOP))
def j12(spark, d):
    e = _edges(spark, d)
    return en.one_hop(e.select(c("src").alias("id")).unionByName(e.select(c("dst").alias("id"))).distinct(), e, 4)


# a question per region name length class would be artificial; brands act as questions naming compounds
NB = """qm AS (SELECT DISTINCT p_brand AS question_id, 'COMPOUND|' || replace(p_name, ' ', '_') AS id FROM part),
 kp AS (SELECT question_id, id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY id) AS n FROM qm) WHERE n <= 6),
 vwg AS (SELECT question_id, kp.id AS src, type, neighbour AS dst FROM kp JOIN hop ON hop.id = kp.id)"""


@query("d14_graph_neighbourhood", sql("""SELECT coalesce(k.question_id, g.question_id) AS question_id, coalesce(k.id, g.id) AS id, k.id IS NOT NULL AS matched, coalesce(g.degree, 0) AS degree FROM kp k FULL JOIN
    (SELECT question_id, id, count(*) AS degree FROM (SELECT DISTINCT question_id, src AS id, src, type, dst FROM vwg UNION SELECT question_id, dst, src, type, dst FROM vwg) GROUP BY ALL) g ON g.question_id=k.question_id AND g.id=k.id""",
    extra=",\n".join([MEN, REL, HOP, NB])))
def d14(spark, d):
    from litquarry.functions.identifiers import key_normalise
    m = table(spark, d, "part", "p_brand", "p_name").select(c("p_brand").alias("question_id"), F.concat(F.lit("COMPOUND|"), key_normalise("p_name")).alias("id"))
    papers = _relations(spark, d).select(c("head").alias("id"), c("document_id").alias("paper"))
    return en.neighbourhood(m, _edges(spark, d), papers, 6)[0]


@query("r10_graph_text_fusion", sql("""SELECT experiment_id, hit_key, score, row_number() OVER (PARTITION BY experiment_id ORDER BY score DESC, hit_key) AS rank FROM (SELECT experiment_id, hit_key, """ + r_sql("sum(1.0/(60+r))", 9) + """ AS score FROM
    (SELECT experiment_id, doc_id AS hit_key, rank AS r FROM bm UNION ALL SELECT experiment_id, canonical, row_number() OVER (PARTITION BY experiment_id ORDER BY canonical) FROM (SELECT DISTINCT item_id AS experiment_id, canonical FROM benchmark, vocab WHERE contains(lower(text), alias)))
    GROUP BY ALL) QUALIFY rank <= 20""", "lines", "chunks", "questions", extra=",\n".join([rq.CPOST, rq.STATS, rq.bm25_ctes("questions", "bm", 50, "1.0"), VOCAB])))
def r10(spark, d):
    """Chunks from BM25 fused with graph entities the question names."""
    from pyspark.sql import Window as W
    q = questions(spark, d)
    text = rt.bm25(rq._chunk_index(spark, d), q, ["experiment_id", "query_no"], 50, {"text": 1.0}).select(
        "experiment_id", "rank", c("doc_id").alias("chunk_id"), F.lit(None).cast("string").alias("graph_entity"), F.lit("").alias("text"))
    found = en.find_terms(q, ["experiment_id"], "query", _vocab(spark, d)).select("experiment_id", "canonical").distinct()
    g = found.select("experiment_id", F.row_number().over(W.partitionBy("experiment_id").orderBy("canonical")).alias("rank"), F.lit(" ").alias("chunk_id"), c("canonical").alias("graph_entity"), F.lit("").alias("text"))
    return fusion.graph_fusion(text, g, 60, 20)


@query("d15_sentence_entities", sql(f"""SELECT canonical, category, count(*) AS sentences, count(DISTINCT document_id) AS documents FROM (SELECT DISTINCT document_id, sn, canonical, category, alias FROM sw JOIN vocab USING (alias)) GROUP BY ALL""",
    extra=VOCAB + r""", ss AS (SELECT doc_id AS document_id, generate_subscripts(l, 1) AS sn, unnest(l) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\s*\n+\s*', '. ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)),
 sw AS (SELECT DISTINCT document_id, sn, unnest(""" + tok("s") + """) AS alias FROM ss)"""))
def d15(spark, d):
    f = en.extract_from_sentences(docs(spark, d), _vocab(spark, d), 2)
    return f.groupBy("canonical", "category").agg(F.count("*").alias("sentences"), F.countDistinct("document_id").alias("documents"))


RULES = [("SPECIES", "affects", "PROCESS", 0.82), ("SPECIES", "has_stage", "STAGE", 0.76)]


@query("d15_sentence_relations", sql("""SELECT head, relation_type, tail, max(confidence) AS confidence, count(*) AS sentences, min(document_id) AS document_id FROM (
    SELECT a.document_id, a.sn, a.canonical AS head, 'affects' AS relation_type, b.canonical AS tail, 0.82 AS confidence FROM se a JOIN se b ON b.document_id=a.document_id AND b.sn=a.sn AND a.category='SPECIES' AND b.category='PROCESS' UNION ALL
    SELECT a.document_id, a.sn, a.canonical, 'has_stage', b.canonical, 0.76 FROM se a JOIN se b ON b.document_id=a.document_id AND b.sn=a.sn AND a.category='SPECIES' AND b.category='STAGE') GROUP BY ALL""",
    extra=VOCAB + r""", ss AS (SELECT doc_id AS document_id, generate_subscripts(l, 1) AS sn, unnest(l) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\s*\n+\s*', '. ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)),
 se AS (SELECT DISTINCT document_id, sn, canonical, category FROM (SELECT DISTINCT document_id, sn, unnest(""" + tok("s") + """) AS alias FROM ss) JOIN vocab USING (alias))"""))
def d15_relations(spark, d):
    f = en.extract_from_sentences(docs(spark, d), _vocab(spark, d), 2)
    return en.sentence_relations(f, RULES).drop("sentence_no")


@query("d15_reviewed_relations")
def d15_reviewed(spark, d):
    """Relations kept when both ends were approved: terms that occur in at least five sentences."""
    f = en.extract_from_sentences(docs(spark, d), _vocab(spark, d), 2)
    approved = f.groupBy("canonical").agg(F.count("*").alias("n")).where("n >= 5")
    return en.apply_relation_review(en.sentence_relations(f, RULES), approved)


# ---- query expansion -----------------------------------------------------------------------------
@query("r11_trigger_expansion", """SELECT item_id, CASE WHEN (contains(lower(text), 'that') OR contains(lower(text), 'with')) AND NOT contains(lower(text), 'erth') THEN text || chr(10) || chr(10) || 'oomycete phytophthora' ELSE text END AS query FROM benchmark""")
def r11(spark, d):
    return table(spark, d, "benchmark").select("item_id", ex.expand_on_trigger(c("text"), ["that", "with"], ["erth"], "oomycete phytophthora").alias("query"))


EXPAND = VOCAB + """, tx AS (SELECT experiment_id, query FROM questions UNION ALL SELECT experiment_id, query FROM sub),
 tm AS (SELECT DISTINCT experiment_id, category, canonical FROM tx, vocab WHERE contains(lower(query), alias)),
 tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, category ORDER BY canonical) AS n FROM tm) WHERE n <= 36),
 rl AS (SELECT DISTINCT canonical, alias AS term FROM vocab WHERE length(alias) >= 9),
 xr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY term) AS n FROM (SELECT DISTINCT experiment_id, term FROM tr JOIN rl USING (canonical))) WHERE n <= 36),
 ql AS (SELECT experiment_id, 0 AS p, '' AS o, query FROM questions UNION ALL SELECT experiment_id, 1, lpad(query_no::VARCHAR, 6, '0'), query FROM sub UNION ALL SELECT experiment_id, 2, category || ' ' || canonical, canonical FROM tr UNION ALL
   SELECT a.experiment_id, 3, a.canonical || ' ' || b.canonical, a.canonical || ' ' || b.canonical FROM tr a JOIN tr b ON b.experiment_id=a.experiment_id AND a.category='SPECIES' AND b.category IN ('PROCESS','STAGE') UNION ALL
   SELECT x.experiment_id, 4, term, query || ' ' || term FROM xr x JOIN questions q ON q.experiment_id=x.experiment_id),
 qu AS (SELECT experiment_id, query_no, query FROM (SELECT experiment_id, query, row_number() OVER (PARTITION BY experiment_id ORDER BY po, query) - 1 AS query_no FROM
   (SELECT experiment_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS query, min((p, o)) AS po FROM ql WHERE trim(query) <> '' GROUP BY ALL)) WHERE query_no < 36)"""


def _expanded(spark, d, translated):
    v = _vocab(spark, d)
    related = v.where(F.length("alias") >= 9).select("canonical", c("alias").alias("term")).distinct()
    return ex.vocabulary_expansion(questions(spark, d), sub_queries(spark, d), v, related, translated)


@query("r12_expansion_with_translated", sql("""SELECT experiment_id, row_number() OVER (PARTITION BY experiment_id ORDER BY po, query) - 1 AS query_no, query FROM (SELECT experiment_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS query, min((p, o)) AS po FROM
    (SELECT experiment_id, 0 AS p, query_no AS o, query FROM qu UNION ALL SELECT experiment_id, 1, query_no, query || ' ' || string_agg(canonical, ' ' ORDER BY canonical) FROM (SELECT DISTINCT experiment_id, query_no, query, canonical FROM qu, vocab WHERE contains(lower(query), alias)) GROUP BY experiment_id, query_no, query)
    GROUP BY ALL) QUALIFY query_no < 36""", "questions", "sub", extra=EXPAND))
def r12_whole(spark, d):
    """The whole expansion: its parts and behind them the translated form of each of their queries."""
    return _expanded(spark, d, True)


@query("r12_translated_queries", sql("""SELECT experiment_id, query_no, query || ' ' || string_agg(canonical, ' ' ORDER BY canonical) AS query FROM (SELECT DISTINCT experiment_id, query_no, query, canonical FROM sub, vocab WHERE contains(lower(query), alias)) GROUP BY experiment_id, query_no, query""", "sub", extra=VOCAB))
def r12_translated(spark, d):
    return ex.translated_queries(sub_queries(spark, d), _vocab(spark, d))


@query("u5_linked_query_union_36", sql("""SELECT experiment_id, row_number() OVER (PARTITION BY experiment_id ORDER BY po, query) - 1 AS query_no, query FROM (SELECT experiment_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS query, min((p, o)) AS po FROM
    (SELECT experiment_id, 0 AS p, 0 AS o, query FROM questions UNION ALL SELECT experiment_id, 1, query_no, query FROM sub) GROUP BY ALL) QUALIFY query_no < 36""", "questions", "sub"))
def u5_whole(spark, d):
    """The union with as many queries as the reference takes."""
    return ex.linked_union([questions(spark, d).withColumnRenamed("query_no", "ord"), sub_queries(spark, d).withColumnRenamed("query_no", "ord")])


ENTQ = f"""en0 AS (SELECT experiment_id, w AS entity, i AS entity_no FROM (SELECT experiment_id, generate_subscripts({tok('query')}, 1) AS i, unnest({tok('query')}) AS w FROM questions) WHERE length(w) >= 9),
 en1 AS (SELECT experiment_id, entity, row_number() OVER (PARTITION BY experiment_id ORDER BY n, entity) AS e FROM (SELECT experiment_id, entity, min(entity_no) AS n FROM en0 GROUP BY ALL) QUALIFY e <= 20),
 xb AS (SELECT s.experiment_id, s.query, row_number() OVER (PARTITION BY s.experiment_id ORDER BY s.query_no) AS x FROM sub s JOIN questions q ON q.experiment_id=s.experiment_id WHERE s.query <> q.query QUALIFY x <= 20),
 eq AS (SELECT experiment_id, 0 AS a, query_no AS b, 0 AS c, query FROM sub UNION ALL SELECT experiment_id, 1, e, 0, entity FROM en1 UNION ALL SELECT e.experiment_id, 1, e, 1, q.query || ' ' || entity FROM en1 e JOIN questions q ON q.experiment_id=e.experiment_id UNION ALL
   SELECT experiment_id, 2, p, 0, query FROM (SELECT x.experiment_id, row_number() OVER (PARTITION BY x.experiment_id ORDER BY x, e) AS p, query || ' ' || entity AS query FROM xb x JOIN en1 e ON e.experiment_id=x.experiment_id) WHERE p <= 20)"""


def _entities(spark, d):
    return questions(spark, d).select("experiment_id", F.posexplode(tokens("query")).alias("entity_no", "entity")).where(F.length("entity") >= 9)


@query("r13_entity_enhanced_queries", sql("""SELECT experiment_id, query, row_number() OVER (PARTITION BY experiment_id ORDER BY o) - 1 AS query_no FROM (SELECT experiment_id, query, min((a, b, c)) AS o FROM eq GROUP BY ALL)""", "questions", "sub", extra=ENTQ))
def r13(spark, d):
    return ex.entity_queries(questions(spark, d), sub_queries(spark, d), _entities(spark, d))


# ---- experiment ----------------------------------------------------------------------------------
@query("r17_judgment_override", """SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 0 THEN 'IRRELEVANT' WHEN toxic=1 THEN 'DISTRACTOR' WHEN quality=1 THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS effective_label FROM labels""")
def r17(spark, d):
    j = labelled(spark, d).withColumn("override_label", F.when(c("document_id") % 10 == 0, "IRRELEVANT"))
    return fusion.effective_judgments(j).select("document_id", "effective_label")


@query("r17_judgment_reuse", """SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'COPIED' ELSE 'KEPT' END AS origin FROM labels""")
def r17_reuse(spark, d):
    j = labelled(spark, d)
    kept = j.where("document_id % 2 = 1").withColumn("experiment_id", F.lit(2)).withColumn("origin", F.lit("KEPT"))
    source = j.withColumn("experiment_id", F.lit(1)).withColumn("origin", F.lit("COPIED"))
    out = fusion.reuse_judgments(kept, source, 2)
    return out.select("document_id", "origin")


@query("r16_experiment_matrix")
def r16(spark, d):
    """Four query families over three routes, fused per family, reranked and measured; its parts have oracles of their own."""
    from litquarry.plans.experiment import run_experiment
    q, s = questions(spark, d), sub_queries(spark, d)
    gold = docs(spark, d).join(labelled(spark, d).where("label = 'RELEVANT'"), "document_id").select(
        F.explode(tokens("title")).alias("entity")).where(F.length("entity") >= 9).groupBy("entity").agg(F.count("*").alias("n")).orderBy(
        c("n").desc(), "entity").limit(ex.MAX_ENTITY_TERMS)  # no more become terms of a query
    gold_entities = q.select("experiment_id").join(F.broadcast(gold), F.lit(True)).select("experiment_id", (-c("n")).alias("entity_no"), "entity")
    families = {"BASELINE": q, "EXPANDED": s, "REVIEW_ENTITY": ex.entity_queries(q, s, _entities(spark, d)),
                "GOLD_ENTITY": ex.entity_queries(q, s, gold_entities)}
    return run_experiment(chunks(spark, d), families, labelled(spark, d))
