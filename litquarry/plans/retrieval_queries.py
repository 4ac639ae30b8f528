"""Retrieval, fusion and retrieval-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from litquarry.functions.core import round_half_up
from litquarry.operators import block_max as bmx, dense, fusion, ir_metrics as ir, retrieval as rt, windows as wn
from litquarry.plans.registry import query
from litquarry.plans.views import chunks, docs, labelled, questions, r_sql, ratio_sql, sql, sub_queries, tok
from litquarry.scale import cut
from litquarry.sources.tables import table

K = 50
BOOSTS = {"title": 3.0, "section": 2.0, "text": 1.0}


def _doc_index(spark, d):
    return rt.build_index(docs(spark, d), "document_id", {f: F.col(f) for f in BOOSTS})


def _chunk_index(spark, d):
    return rt.materialised(rt.build_index(chunks(spark, d), "chunk_id", {"text": F.col("text")}))


# SQL fragments ------------------------------------------------------------------------------------
POST = f"""tokd AS (
    SELECT document_id AS doc_id, 'title' AS field, {tok('title')} AS t FROM docs UNION ALL
    SELECT document_id, 'section', {tok('section')} FROM docs UNION ALL
    SELECT document_id, 'text', {tok('text')} FROM docs),
 posting AS (SELECT doc_id, field, dl, term, count(*) AS tf FROM
    (SELECT doc_id, field, len(t) AS dl, unnest(t) AS term FROM tokd) GROUP BY ALL)"""

STATS = """fstat AS (SELECT field, count(*) AS n_docs, sum(dl)::DOUBLE/count(*) AS avgdl FROM
    (SELECT DISTINCT doc_id, field, dl FROM posting) GROUP BY field),
 dfreq AS (SELECT field, term, count(*) AS df FROM posting GROUP BY ALL)"""


def bm25_ctes(queries: str, name: str, k: int, boost: str) -> str:
    return f"""qt_{name} AS (SELECT experiment_id, query_no, term, count(*) AS qtf FROM
    (SELECT experiment_id, query_no, unnest({tok('query')}) AS term FROM {queries}) GROUP BY ALL),
 sc_{name} AS (SELECT experiment_id, query_no, doc_id,
    {r_sql(f"sum(qtf*{boost}*ln(1+(n_docs-df+0.5)/(df+0.5))*(tf/(tf+1.2*(0.25+0.75*dl/avgdl))))", 6)} AS score
    FROM posting JOIN fstat USING (field) JOIN dfreq USING (field, term) JOIN qt_{name} USING (term)
    GROUP BY experiment_id, query_no, doc_id),
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, query_no
    ORDER BY score DESC, doc_id) AS rank FROM sc_{name}) WHERE rank <= {k})"""


BOOST_SQL = "(CASE field WHEN 'title' THEN 3.0 WHEN 'section' THEN 2.0 ELSE 1.0 END)"

CPOST = f"""posting AS (SELECT doc_id, 'text' AS field, dl, term, count(*) AS tf FROM
    (SELECT chunk_id AS doc_id, len({tok('text')}) AS dl, unnest({tok('text')}) AS term FROM chunks) GROUP BY ALL)"""


@query("r1_inverted_index", sql("SELECT doc_id, field, dl, term, tf FROM posting", "docs", extra=POST))
def r1(spark: SparkSession, d: str) -> DataFrame:
    return _doc_index(spark, d).postings


@query("r1_index_statistics", sql(f"""SELECT f.field, n_docs, {r_sql('avgdl')} AS avgdl, count(*) AS terms,
    CAST(sum(df) AS BIGINT) AS postings, max(df) AS max_df FROM fstat f JOIN dfreq USING (field)
    GROUP BY f.field, n_docs, avgdl""", "docs", extra=POST + ",\n" + STATS))
def r1_stats(spark, d):
    ix = _doc_index(spark, d)
    per = ix.document_frequency().groupBy("field").agg(
        F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("max_df"))
    return ix.field_stats().join(per, "field").withColumn("avgdl", round_half_up("avgdl"))


MAINT = f"""posting0 AS (SELECT * FROM posting WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0),
 chg AS (SELECT doc_id, 'text' AS field, len({tok('line')}) AS dl, unnest({tok('line')}) AS term FROM
    (SELECT document_id AS doc_id, title AS line FROM docs WHERE document_id % 7 = 0 AND document_id % 5 <> 0))"""


@query("r2_index_update_delete", sql("""SELECT doc_id, field, dl, term, tf FROM posting0 UNION ALL
    SELECT doc_id, field, dl, term, count(*) FROM chg GROUP BY ALL""", "docs", extra=POST + ",\n" + MAINT))
def r2(spark, d):
    """Every seventh document is re-indexed by its first line, every fifth is deleted."""
    base = docs(spark, d)
    changed = rt.build_index(base.where("document_id % 7 = 0"), "document_id", {"text": F.col("title")})
    deleted = base.where("document_id % 5 = 0").select(F.col("document_id").alias("doc_id"))
    return rt.update_index(_doc_index(spark, d), changed, deleted).postings


@query("r2_index_count_check", sql("""SELECT (SELECT count(DISTINCT doc_id) FROM posting) AS indexed,
    (SELECT count(DISTINCT document_id) FROM docs) AS stored,
    (SELECT count(DISTINCT doc_id) FROM posting) <> (SELECT count(DISTINCT document_id) FROM docs) AS rebuild""",
    "docs", extra=POST))
def r2_check(spark, d):
    return rt.needs_rebuild(_doc_index(spark, d), docs(spark, d), "document_id")


@query("r3_bm25_multi_field", sql("SELECT experiment_id, query_no, doc_id, score, rank FROM bm", "docs", "questions",
       extra=",\n".join([POST, STATS, bm25_ctes("questions", "bm", K, BOOST_SQL)])))
def r3(spark, d):
    return rt.bm25(rt.materialised(_doc_index(spark, d)), questions(spark, d), ["experiment_id", "query_no"], K, BOOSTS)


@query("r3_bm25_block_max", sql("SELECT experiment_id, query_no, doc_id, score, rank FROM bm", "docs", "sub",
       extra=",\n".join([POST, STATS, bm25_ctes("sub", "bm", 10, BOOST_SQL)])))
def r3_blocks(spark, d):
    """Ten best documents of every sentence of a question, blocks of postings skipped by their bound."""
    index = bmx.build_blocks(docs(spark, d), "document_id", {f: F.col(f) for f in BOOSTS})
    return bmx.search(index, sub_queries(spark, d), ["experiment_id", "query_no"], 10, BOOSTS).hits


FTS = f"""qf AS (SELECT DISTINCT experiment_id, query_no, term FROM
    (SELECT experiment_id, query_no, unnest({tok('query')}) AS term FROM sub)),
 qn AS (SELECT experiment_id, query_no, count(*) AS n_terms FROM qf GROUP BY ALL),
 bydoc AS (SELECT doc_id, term, sum(tf) AS tf FROM posting GROUP BY ALL),
 fs AS (SELECT experiment_id, query_no, doc_id, count(*) AS n, {r_sql('sum(ln(1+tf))', 6)} AS score
    FROM bydoc JOIN qf USING (term) GROUP BY ALL),
 fts AS (SELECT * FROM (SELECT experiment_id, query_no, doc_id, score, row_number() OVER (
    PARTITION BY experiment_id, query_no ORDER BY score DESC, doc_id) AS rank FROM fs JOIN qn USING (experiment_id, query_no)
    WHERE n = n_terms) WHERE rank <= {K})"""


def _fts(spark, d):
    return rt.text_match(rt.materialised(_doc_index(spark, d)), sub_queries(spark, d), ["experiment_id", "query_no"], K)


@query("r4_text_match_all_terms", sql("SELECT * FROM fts", "docs", "sub", extra=POST + ",\n" + FTS))
def r4(spark, d):
    return _fts(spark, d)


SECTION_RANK_SQL = """CASE WHEN lower(section_path) LIKE '%result%' THEN 1 WHEN lower(section_path) LIKE '%discussion%' THEN 2
    WHEN lower(section_path) LIKE '%conclusion%' THEN 3 WHEN lower(section_path) LIKE '%abstract%' THEN 4
    WHEN lower(section_path) LIKE '%intro%' THEN 5 ELSE 6 END"""
PRIORITY = f"""prio AS (SELECT * FROM (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id
    ORDER BY {SECTION_RANK_SQL}, chunk_id) AS chunk_rank FROM chunks) WHERE chunk_rank <= 2)"""
FTS_CHUNKS = """fdoc AS (SELECT experiment_id, query_no, doc_id AS document_id, rank AS doc_rank, score FROM fts),
 ftsc AS (SELECT experiment_id, query_no, document_id, chunk_id, score,
    row_number() OVER (PARTITION BY experiment_id, query_no ORDER BY doc_rank, chunk_rank NULLS FIRST) AS rank
    FROM fdoc LEFT JOIN prio USING (document_id))"""


def _priority(spark, d, n=2):
    return wn.priority_chunks(chunks(spark, d), n).select("document_id", "chunk_id", "chunk_rank")


@query("r5_text_match_priority_chunks", sql("SELECT * FROM ftsc", "docs", "sub", "lines", "chunks",
       extra=",\n".join([POST, FTS, PRIORITY, FTS_CHUNKS])))
def r5(spark, d):
    return fusion.expand_with_chunks(_fts(spark, d).withColumnRenamed("doc_id", "document_id"), _priority(spark, d))


def _vectors(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _query_vectors(spark, d):
    items = table(spark, d, "benchmark", "item_id")
    return items.join(_vectors(spark, d), F.col("item_id") == F.col("id")).select(
        F.col("item_id").alias("query_id"), "vector")


KNN = f"""qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS qvec FROM benchmark JOIN embeddings ON item_id = vec_id),
 ks AS (SELECT query_id, vec_id AS id, {r_sql('(list_cosine_similarity(qvec, embedding::DOUBLE[])+1)/2', 6)} AS score
    FROM qv, embeddings),
 knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM ks WHERE score >= 0.4) WHERE rank <= {K})"""


@query("r6_dense_top_k", sql("SELECT * FROM knn", extra=KNN))
def r6(spark, d):
    return rt.knn(_vectors(spark, d), _query_vectors(spark, d), K, 0.4)


MANY = 10
KNN_MANY = f"""ms AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
    {r_sql('(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])+1)/2', 6)} AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


@query("r6_dense_many_queries", sql(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM ms WHERE score >= 0.4) WHERE rank <= {MANY}""", extra=KNN_MANY))
def r6_many(spark, d):
    """Nearest others of every vector, cells that cannot hold one skipped."""
    v = _vectors(spark, d)
    return dense.knn_cells(v, v.withColumnRenamed("id", "query_id"), MANY, 0.4, exclude_self=True)


@query("r6_dense_probed_cells")
def r6_probed(spark, d):
    """Approximate form of ``r6_dense_many_queries``; tests hold its recall at 0.9 or more."""
    v = _vectors(spark, d)
    return dense.knn_cells(v, v.withColumnRenamed("id", "query_id"), MANY, 0.4, exclude_self=True, probes=dense.PROBES)


# ---- three routes and their fusion ---------------------------------------------------------------
# lexical hits are chunks; dense hits stand for documents; text match gives priority chunks


def _bm25_chunk_route(spark, d, queries, route):
    hits = rt.bm25(_chunk_index(spark, d), queries, ["experiment_id", "query_no"], K, {"text": 1.0})
    per_query = hits.join(queries, ["experiment_id", "query_no"]).select(
        "experiment_id", "query_no", "query", "rank",
        F.substring_index("doc_id", ":", 1).cast("long").alias("document_id"), F.col("doc_id").alias("chunk_id"), "score")
    return cut(fusion.route_hits(per_query, route))


def _dense_route(spark, d, route="DENSE"):
    q = questions(spark, d)
    per_query = rt.knn(_vectors(spark, d), _query_vectors(spark, d), K, 0.0).join(
        q, F.col("query_id") == F.col("experiment_id")).select(
        "experiment_id", "query_no", "query", "rank", F.col("id").alias("document_id"),
        F.lit(None).cast("string").alias("chunk_id"), "score")
    return fusion.route_hits(per_query, route)


def _fts_route(spark, d, route="FTS"):
    per_query = r5(spark, d).join(sub_queries(spark, d), ["experiment_id", "query_no"])
    return fusion.route_hits(per_query, route)


def _routes(spark, d):
    """Hits of all routes, at most k rows per query and route; materialised, as pools and metrics read them again."""
    return (_bm25_chunk_route(spark, d, sub_queries(spark, d), "BM25")
            .unionByName(cut(_dense_route(spark, d).unionByName(_fts_route(spark, d)))))


def _route_sql(src: str, route: str) -> str:
    """``src`` has experiment_id, query_no, query, rank, document_id, chunk_id, score."""
    key = "CASE WHEN chunk_id IS NULL OR trim(chunk_id)='' THEN 'doc:' || document_id ELSE 'chunk:' || chunk_id END"
    return f"""(SELECT experiment_id, '{route}' AS route, query_no, query,
    row_number() OVER (PARTITION BY experiment_id ORDER BY query_no, rank, key) AS rank, document_id, chunk_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, key ORDER BY query_no, rank) AS n
      FROM (SELECT *, {key} AS key FROM {src})) WHERE n = 1)"""


def _fts_sql() -> str:
    # document postings under their own name, since "posting" holds the chunk postings here
    return ",\n".join([
        POST.replace("posting AS", "dposting AS"),
        FTS.replace("FROM posting", "FROM dposting"), PRIORITY, FTS_CHUNKS])


KNN0 = KNN.replace("WHERE score >= 0.4", "WHERE score >= 0.0")
HITS = ",\n".join([
    CPOST, STATS, bm25_ctes("sub", "bm", K, "1.0"), _fts_sql(), KNN0,
    f"""bmq AS (SELECT b.experiment_id, b.query_no, s.query, b.rank, CAST(split_part(doc_id, ':', 1) AS BIGINT) AS document_id,
      doc_id AS chunk_id, b.score FROM bm b JOIN sub s USING (experiment_id, query_no)),
    dnq AS (SELECT query_id AS experiment_id, 0 AS query_no, text AS query, rank, id AS document_id,
      CAST(NULL AS VARCHAR) AS chunk_id, score FROM knn JOIN benchmark ON item_id = query_id),
    fsq AS (SELECT f.experiment_id, f.query_no, s.query, f.rank, f.document_id, f.chunk_id, f.score
      FROM ftsc f JOIN sub s USING (experiment_id, query_no)),
    hits AS (SELECT * FROM {_route_sql('bmq', 'BM25')} UNION ALL SELECT * FROM {_route_sql('dnq', 'DENSE')}
      UNION ALL SELECT * FROM {_route_sql('fsq', 'FTS')})"""])
HV = ("docs", "lines", "chunks", "questions", "sub", "labelled")
HKEY = "CASE WHEN chunk_id IS NULL OR trim(chunk_id)='' THEN 'doc:' || document_id ELSE 'chunk:' || chunk_id END"


def rrf_sql(routes: str, out: str, src: str = "hits", limit: str = "") -> str:
    return f"""(SELECT experiment_id, '{out}' AS route, query_no, query, row_number() OVER (PARTITION BY experiment_id
      ORDER BY score DESC, key) AS rank, document_id, chunk_id, score FROM
      (SELECT experiment_id, key, {r_sql('sum(1.0/(60+rank))', 9)} AS score, min(document_id) AS document_id,
       min(chunk_id) AS chunk_id, min(query_no) AS query_no, string_agg(DISTINCT query, ' | ' ORDER BY query) AS query
       FROM (SELECT *, {HKEY} AS key FROM {src} WHERE route IN ({routes})) GROUP BY experiment_id, key) {limit})"""


ALL = HITS + ",\n" + f"allhits AS (SELECT * FROM hits UNION ALL SELECT * FROM {rrf_sql(chr(39)+'BM25'+chr(39)+','+chr(39)+'DENSE'+chr(39)+','+chr(39)+'FTS'+chr(39), 'OVERALL')})"


def _all_hits(spark, d):
    return _with_overall(_routes(spark, d))


def _with_overall(hits):
    return hits.unionByName(fusion.rrf(hits, ["BM25", "DENSE", "FTS"], "OVERALL"))


@query("r7_reciprocal_rank_fusion", sql("SELECT * EXCLUDE (query) FROM allhits WHERE route='OVERALL'", *HV, extra=ALL))
def r7(spark, d):
    return fusion.rrf(_routes(spark, d), ["BM25", "DENSE", "FTS"], "OVERALL").drop("query")


@query("u1_union_of_routes", sql("""SELECT route, count(*) AS hits, count(DISTINCT document_id) AS documents,
    count(DISTINCT experiment_id) AS experiments, max(rank) AS max_rank FROM allhits GROUP BY route""", *HV, extra=ALL))
def u1(spark, d):
    return _all_hits(spark, d).groupBy("route").agg(
        F.count("*").alias("hits"), F.countDistinct("document_id").alias("documents"),
        F.countDistinct("experiment_id").alias("experiments"), F.max("rank").alias("max_rank"))


@query("t1_top_k_per_query", sql("SELECT experiment_id, query_no, doc_id, score, rank FROM bm", "docs", "sub",
       extra=",\n".join([POST, STATS, bm25_ctes("sub", "bm", 10, BOOST_SQL)])))
def t1(spark, d):
    return rt.bm25(rt.materialised(_doc_index(spark, d)), sub_queries(spark, d), ["experiment_id", "query_no"], 10, BOOSTS)


@query("w3_renumber_after_scope", sql(f"""SELECT experiment_id, route, query_no, row_number() OVER (
    PARTITION BY experiment_id, route ORDER BY rank, {HKEY}) AS rank, document_id, chunk_id, score FROM hits
    WHERE document_id IN (SELECT document_id FROM labelled)""", *HV, extra=HITS))
def w3(spark, d):
    return fusion.scope_to(_routes(spark, d), labelled(spark, d)).drop("query")


@query("w4_first_hit_per_document", sql("""SELECT experiment_id, route, query_no, rank, document_id, chunk_id, score FROM
    (SELECT *, row_number() OVER (PARTITION BY experiment_id, route, document_id ORDER BY rank) AS n FROM hits)
    WHERE n = 1""", *HV, extra=HITS))
def w4(spark, d):
    return fusion.first_hit_per_document(_routes(spark, d)).drop("query")


@query("p8_query_marker_filter", sql(f"""SELECT experiment_id, route, query_no, row_number() OVER (
    PARTITION BY experiment_id, route ORDER BY rank, {HKEY}) AS rank, document_id, chunk_id, score FROM hits
    WHERE route IN ('BM25','DENSE') AND contains(lower(query), 'erth')""", *HV, extra=HITS))
def p8(spark, d):
    return fusion.marker_filter(_routes(spark, d), ["BM25", "DENSE"], " Erth ").drop("query")


@query("r8_hybrid_dense_lexical", sql(f"SELECT * EXCLUDE (query) FROM {rrf_sql(chr(39)+'BM25'+chr(39)+','+chr(39)+'DENSE'+chr(39), 'hybrid')} WHERE rank <= 15", *HV, extra=HITS))
def r8(spark, d):
    return fusion.hybrid(_dense_route(spark, d), _bm25_chunk_route(spark, d, sub_queries(spark, d), "BM25"), 60, 15).drop("query")


@query("r9_document_level_fusion", sql(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id
    ORDER BY score DESC, CAST(document_id AS VARCHAR)) AS rank FROM (SELECT experiment_id, document_id,
      {r_sql('sum(1.0/(60+r))', 9)} AS score, count(DISTINCT query_no) AS matched_queries,
      count(DISTINCT nullif(trim(chunk_id), '')) AS matched_chunks FROM
      (SELECT *, row_number() OVER (PARTITION BY experiment_id, query_no, route ORDER BY rank, key) AS r FROM
        (SELECT *, row_number() OVER (PARTITION BY experiment_id, query_no, route, key ORDER BY rank) AS n FROM
          (SELECT *, {HKEY} AS key FROM hits WHERE route <> 'FTS')) WHERE n = 1) GROUP BY experiment_id, document_id))
    WHERE rank <= 20""", *HV, extra=HITS))
def r9(spark, d):
    return fusion.document_fusion(_routes(spark, d).where("route <> 'FTS'"), 60, 20)


# ---- judgments from the pooled hits --------------------------------------------------------------
POOL = """pool AS (SELECT DISTINCT experiment_id, document_id, label FROM hits JOIN labelled USING (document_id)),
 keyc AS (SELECT DISTINCT p.experiment_id, c.chunk_id FROM pool p JOIN prio c USING (document_id) WHERE label = 'RELEVANT')"""


def _pool(spark, d, hits):
    """Judgments per experiment: labels of every document any of its routes returned."""
    return hits.select("experiment_id", "document_id").distinct().join(labelled(spark, d), "document_id")


def _key_chunks(spark, d, pool):
    return pool.where("label = 'RELEVANT'").join(_priority(spark, d), "document_id").select("experiment_id", "chunk_id")


def metrics_sql(src: str) -> str:
    cuts = "(SELECT unnest([5,10,20,50,100,0]) AS cut)"
    return f"""f1 AS (SELECT experiment_id, route, document_id, min(rank) AS first_rank FROM {src}
      WHERE document_id IS NOT NULL GROUP BY ALL),
    f2 AS (SELECT f1.*, row_number() OVER (PARTITION BY f1.experiment_id, route ORDER BY first_rank, document_id) AS pos, label,
      CASE WHEN label='RELEVANT' THEN 1 ELSE 0 END AS rel FROM f1 LEFT JOIN pool USING (experiment_id, document_id)),
    f3 AS (SELECT *, sum(rel) OVER (PARTITION BY experiment_id, route ORDER BY pos) AS seen FROM f2),
    f4 AS (SELECT experiment_id, route, cut, count(*) AS retrieved, sum(rel) AS relevant,
      count(*) FILTER (label='DISTRACTOR') AS distractor, count(*) FILTER (label='IRRELEVANT') AS irrelevant,
      min(pos) FILTER (rel=1) AS first_rel, sum(CASE WHEN rel=1 THEN 1/log2(pos+1) ELSE 0 END) AS dcg,
      sum(CASE WHEN rel=1 THEN seen::DOUBLE/pos ELSE 0 END) AS prec_sum FROM f3, {cuts} c
      WHERE cut=0 OR first_rank<=cut GROUP BY ALL),
    f5 AS (SELECT h.experiment_id, route, cut, count(*) AS n_hits, count(k.chunk_id) AS key_hits,
      count(DISTINCT k.chunk_id) AS key_found FROM {src} h LEFT JOIN keyc k ON k.experiment_id=h.experiment_id
      AND k.chunk_id=h.chunk_id, {cuts} c WHERE cut=0 OR rank<=cut GROUP BY ALL),
    f6 AS (SELECT experiment_id, count(*) FILTER (label='RELEVANT') AS n_rel FROM pool GROUP BY ALL),
    f7 AS (SELECT experiment_id, count(*) AS n_keys FROM keyc GROUP BY ALL),
    f8 AS (SELECT s.experiment_id, s.route, s.cut, coalesce(retrieved,0) AS retrieved, coalesce(relevant,0) AS relevant,
      coalesce(distractor,0) AS distractor, coalesce(irrelevant,0) AS irrelevant, first_rel, coalesce(dcg,0) AS dcg,
      coalesce(prec_sum,0) AS prec_sum, coalesce(n_hits,0) AS n_hits, coalesce(key_hits,0) AS key_hits,
      coalesce(key_found,0) AS key_found, coalesce(n_rel,0) AS n_rel, coalesce(n_keys,0) AS n_keys
      FROM (SELECT DISTINCT experiment_id, route, cut FROM {src}, {cuts} c) s
      LEFT JOIN f4 USING (experiment_id, route, cut) LEFT JOIN f5 USING (experiment_id, route, cut)
      LEFT JOIN f6 USING (experiment_id) LEFT JOIN f7 USING (experiment_id)),
    f9 AS (SELECT *, coalesce((SELECT sum(1/log2(i+1)) FROM range(1, 100000) t(i)
      WHERE i <= least(CASE WHEN cut>0 THEN cut ELSE retrieved END, n_rel)), 0) AS idcg FROM f8)"""


METRIC_SELECT = f"""SELECT experiment_id, route, CAST(cut AS INT) AS cut, {ratio_sql('relevant','n_rel')} AS recall,
    {ratio_sql('relevant','retrieved')} AS precision, {ratio_sql('distractor','retrieved')} AS distractor_rate,
    {ratio_sql('irrelevant','retrieved')} AS irrelevant_rate, retrieved, CAST(n_rel-relevant AS BIGINT) AS missed_relevant,
    {ratio_sql('key_found','n_keys')} AS key_chunk_recall,
    CASE WHEN cut>0 THEN {ratio_sql('key_hits','n_hits')} ELSE {ratio_sql('relevant','n_rel')} END AS recall_at_k,
    CASE WHEN cut>0 THEN {ratio_sql('relevant','cut')} ELSE {ratio_sql('relevant','retrieved')} END AS precision_at_k,
    coalesce({ratio_sql('1','first_rel')}, 0) AS mrr, {ratio_sql('dcg','idcg')} AS ndcg,
    {ratio_sql('prec_sum','n_rel')} AS average_precision FROM f9"""


@query("r15_ir_metrics", sql(METRIC_SELECT, *HV, extra=",\n".join([ALL, POOL, metrics_sql("allhits")])))
def r15(spark, d):
    routes = _routes(spark, d)
    hits, pool = _with_overall(routes), _pool(spark, d, routes)
    return ir.ir_metrics(hits, pool, _key_chunks(spark, d, pool))


@query("r15_ir_metrics_bm25", sql(METRIC_SELECT, *HV, extra=",\n".join([
    HITS, "bhits AS (SELECT * FROM hits WHERE route='BM25')", POOL.replace("FROM hits", "FROM bhits"), metrics_sql("bhits")])))
def r15_bm25(spark, d):
    hits = _bm25_chunk_route(spark, d, sub_queries(spark, d), "BM25")
    pool = _pool(spark, d, hits)
    return ir.ir_metrics(hits, pool, _key_chunks(spark, d, pool))


@query("w5_running_precision", sql("""SELECT experiment_id, route, document_id, first_rank, pos, label, rel,
    CAST(seen AS BIGINT) AS rel_seen FROM f3""", *HV, extra=",\n".join([ALL, POOL, metrics_sql("allhits")])))
def w5(spark, d):
    routes = _routes(spark, d)
    return ir.document_positions(_with_overall(routes), _pool(spark, d, routes))


@query("u2_missed_relevant", sql("""SELECT r.experiment_id, r.route, CAST(r.cut AS INT) AS cut, p.document_id FROM
    (SELECT DISTINCT experiment_id, route, cut FROM hits, (SELECT unnest([5,10,20,50,100,0]) AS cut)) r
    JOIN pool p ON p.experiment_id = r.experiment_id AND p.label='RELEVANT' WHERE NOT EXISTS (SELECT 1 FROM hits h
    WHERE h.experiment_id=r.experiment_id AND h.route=r.route AND h.document_id=p.document_id AND (r.cut=0 OR h.rank<=r.cut))""",
    *HV, extra=HITS + ",\n" + POOL))
def u2(spark, d):
    hits = _routes(spark, d)
    return ir.missed_documents(hits, _pool(spark, d, hits))


@query("u2_missed_key_chunks", sql("""SELECT r.experiment_id, r.route, CAST(r.cut AS INT) AS cut, k.chunk_id FROM
    (SELECT DISTINCT experiment_id, route, cut FROM hits, (SELECT unnest([5,10,20,50,100,0]) AS cut)) r
    JOIN keyc k ON k.experiment_id = r.experiment_id WHERE NOT EXISTS (SELECT 1 FROM hits h
    WHERE h.experiment_id=r.experiment_id AND h.route=r.route AND h.chunk_id=k.chunk_id AND (r.cut=0 OR h.rank<=r.cut))""",
    *HV, extra=HITS + ",\n" + POOL))
def u2_chunks(spark, d):
    hits = _routes(spark, d)
    return ir.missed_key_chunks(hits, _key_chunks(spark, d, _pool(spark, d, hits)))


@query("u3_retrieved_relevant", sql("""SELECT DISTINCT experiment_id, route, document_id FROM hits JOIN labelled
    USING (document_id) WHERE label='RELEVANT'""", *HV, extra=HITS))
def u3(spark, d):
    hits = _routes(spark, d)
    return ir.retrieved_relevant(hits, _pool(spark, d, hits))


RERANK = f"""ov AS (SELECT * FROM allhits WHERE route='OVERALL'),
 cd AS (SELECT experiment_id, document_id, row_number() OVER (PARTITION BY experiment_id ORDER BY r) AS doc_rank FROM
   (SELECT experiment_id, document_id, min(rank) AS r FROM ov GROUP BY ALL)),
 sc AS (SELECT experiment_id, document_id, doc_rank, coalesce(CASE WHEN label='RELEVANT' THEN 0.9 WHEN label='DISTRACTOR'
   THEN 0.6 ELSE 0.1 END, 0.0) AS rerank_score FROM cd LEFT JOIN labelled USING (document_id))"""
def _rerank(spark, d):
    hits = _all_hits(spark, d)
    cand = fusion.renumber(fusion.first_hit_per_document(hits.where("route = 'OVERALL'"))).select(
        "experiment_id", "document_id", F.col("rank").alias("doc_rank"))
    scores = _pool(spark, d, hits).withColumn("rerank_score", F.when(F.col("label") == "RELEVANT", 0.9).when(
        F.col("label") == "DISTRACTOR", 0.6).otherwise(0.1)).drop("label")
    return cand, scores


@query("r14_rerank_threshold", sql("""SELECT experiment_id, document_id, doc_rank, rerank_score, row_number() OVER (
    PARTITION BY experiment_id ORDER BY rerank_score DESC, doc_rank) AS rank FROM
    (SELECT experiment_id, document_id, doc_rank, CASE WHEN label IS NULL THEN 0.0 ELSE rerank_score END AS rerank_score
     FROM sc LEFT JOIN labelled USING (document_id)) WHERE rerank_score >= 0.5""", *HV, extra=ALL + ",\n" + RERANK))
def r14(spark, d):
    return fusion.apply_rerank(*_rerank(spark, d), min_score=0.5)


@query("r14_rerank_document_text", sql(f"""SELECT experiment_id, document_id, doc_rank,
    CASE WHEN length(t) <= 7800 THEN t ELSE substr(t, 1, 7800) || chr(10) || '[truncated]' END AS doc_text FROM
    (SELECT c.experiment_id, c.document_id, doc_rank, 'Document ID: ' || c.document_id || chr(10)
      || CASE WHEN coalesce(max(title),'')<>'' THEN 'Title: ' || max(title) || chr(10) ELSE '' END
      || 'Candidate query evidence: ' || max(q) || chr(10) || coalesce(string_agg(chr(10) || 'Evidence ' || n || chr(10)
      || 'Section: ' || section_path || chr(10) || text, '' ORDER BY n), '') AS t FROM
      (SELECT cd.*, o.query AS q FROM cd JOIN ov o ON o.experiment_id=cd.experiment_id AND o.document_id=cd.document_id
        QUALIFY row_number() OVER (PARTITION BY cd.experiment_id, cd.document_id ORDER BY o.rank)=1) c
      LEFT JOIN (SELECT k.*, row_number() OVER (PARTITION BY k.experiment_id, k.document_id ORDER BY pref NULLS LAST,
        chunk_index, chunk_id) AS n FROM (SELECT cd.experiment_id, ch.document_id, ch.chunk_id, chunk_index, section_path, ch.text,
        trim(split_part(dd.text, chr(10), 1)) AS title, (SELECT min(rank) FROM ov WHERE ov.experiment_id=cd.experiment_id AND
        ov.document_id=cd.document_id AND ov.chunk_id=ch.chunk_id) AS pref FROM cd JOIN chunks ch USING (document_id)
        JOIN docs dd USING (document_id)) k) x
      ON x.experiment_id=c.experiment_id AND x.document_id=c.document_id AND n <= 5
     GROUP BY c.experiment_id, c.document_id, doc_rank)""".replace(
    "|| section_path ||", "|| trim(section_path) ||").replace("|| text,", "|| trim(text),"), *HV, extra=ALL + ",\n" + RERANK))
def r14_text(spark, d):
    titled = chunks(spark, d).join(docs(spark, d).select("document_id", "title"), "document_id")
    return fusion.rerank_candidates(_all_hits(spark, d), titled, "OVERALL").drop("query")
