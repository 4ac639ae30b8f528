"""Source, page, table, metadata, review and telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.operators import documents as do
from litquarry.plans.registry import query
from litquarry.plans.report_queries import step_events
from litquarry.plans.views import chunks, docs, labelled, r_sql, ratio_sql, sql
from litquarry.sources import markup_tables as mt, scans as sc
from litquarry.sources.tables import table
from litquarry.streaming.ingest import usage_stream

c = F.col

# ---- scans over lines made from the tables -------------------------------------------------------
@query("s1_chunk_lines", sql("""SELECT chunk_id, chunk_index, text FROM chunks WHERE chunk_index % 9 <> 4""", "lines", "chunks"))
def s1(spark, d):
    return sc.parse_chunks(_chunk_lines(spark, d))[0].select("chunk_id", "chunk_index", "text")


def _chunk_lines(spark, d):
    body = F.to_json(F.struct(c("document_id").cast("string").alias("document_id"), "chunk_id", "chunk_index", "section_path", "text"))
    return chunks(spark, d).select(F.when(c("chunk_index") % 9 == 4, F.substring(body, 1, 25)).otherwise(body).alias("value"))


@query("s1_skipped_chunk_lines", sql("SELECT 'MALFORMED_JSON' AS reason, count(*) AS n FROM chunks WHERE chunk_index % 9 = 4", "lines", "chunks"))
def s1_skipped(spark, d):
    return sc.parse_chunks(_chunk_lines(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


def _corpus_lines(spark, d):
    t = docs(spark, d)
    a = F.to_json(F.struct(c("document_id").cast("string").alias("documentId"), "title", c("text").alias("abstractText"), F.lit("https://doi.org/10.1000/X.").alias("doi_normalized")))
    b = F.to_json(F.struct(c("document_id").cast("string").alias("document_id"), "title", c("text").alias("abstract")))
    n = c("document_id")
    return t.select(F.when(n % 11 == 0, "{broken").when(n % 13 == 0, "  ").when(n % 2 == 0, a).otherwise(b).alias("value"))


@query("s2_corpus_records", """SELECT doc_id::VARCHAR AS document_id, split_part(text, chr(10), 1) AS title, length(text) AS abstract_chars, CASE WHEN doc_id % 2 = 0 THEN '10.1000/x' END AS doi FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id IN (SELECT doc_id FROM labels)""")
def s2(spark, d):
    return _corpus(spark, d)[0].select("document_id", "title", F.length("abstract").alias("abstract_chars"), "doi")


def _corpus(spark, d):
    ids = table(spark, d, "labels", "doc_id").select(c("doc_id").cast("string").alias("document_id"))
    return sc.parse_corpus(_corpus_lines(spark, d), ids)


@query("s2_corpus_excluded", """SELECT status, count(*) AS n FROM (SELECT 'INPUT_INVALID' AS status FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'OUTSIDE_ID_LIST' FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'MISSING_DOCUMENT' FROM labels WHERE doc_id % 11 = 0 OR doc_id % 13 = 0) GROUP BY 1""")
def s2_excluded(spark, d):
    return _corpus(spark, d)[1].groupBy("status").agg(F.count("*").alias("n"))


@query("s4_candidate_selection", """SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('machinery', 'furniture') AND c_custkey IN (SELECT o_custkey FROM orders) ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 50""")
def s4(spark, d):
    from litquarry.functions.core import md5_order
    allow = table(spark, d, "orders", "o_custkey").select(c("o_custkey").alias("c_custkey"))
    return sc.select_candidates(table(spark, d, "customer", "c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", ["Machinery", "FURNITURE"], allow, md5_order("c_custkey", 42), 50).select("c_custkey")


@query("s5_embedding_store_scan", "SELECT vec_id, label, text, source FROM embeddings JOIN documents ON doc_id = vec_id")
def s5(spark, d):
    e, t = table(spark, d, "embeddings", "vec_id", "label"), table(spark, d, "documents", "doc_id", "text", "source")
    return e.join(t, e.vec_id == t.doc_id).select("vec_id", "label", "text", "source")


@query("s6_gold_lines", """SELECT doc_id::VARCHAR AS document_id, CASE WHEN quality=1 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS classification, 1 AS n_rows FROM labels WHERE doc_id % 5 > 1""")
def s6(spark, d):
    t = table(spark, d, "labels")
    body = F.to_json(F.struct(c("doc_id").cast("string").alias("document_id"), F.when(c("quality") == 1, "SUPPORTED").otherwise("NOT_SUPPORTED").alias("classification"),
                              F.array(F.struct(F.array(F.lit("a"), F.lit("b")).alias("cells"))).alias("rows")))
    k = c("doc_id") % 5
    lines = t.select(F.when(k == 0, " # comment").when(k == 1, "").otherwise(body).alias("value"))
    return sc.parse_gold(lines).select("document_id", "classification", F.size("rows").alias("n_rows"))


def _markdown(spark, d):
    from litquarry.functions.cells import markdown_row
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = c("p_partkey")
    head = F.when(k % 10 == 3, "| Compound | Oops | Kind |").otherwise("| Compound | Source | Kind |")
    sep = F.when(k % 10 == 7, "| a | b | c |").otherwise("| --- | :---: | --- |")
    r1 = markdown_row(F.array(F.concat_ws("|", "p_name", "p_type"), c("p_brand"), c("p_type")))
    r2, r3, r4 = F.concat(F.lit("| "), c("p_name"), F.lit(" |")), F.lit("| x | y | z | too long |"), F.lit("|  |  |  |")
    return p.select(k.alias("path"), F.concat_ws("\n", F.lit("# Evidence"), head, sep, r1, r1, r2, r3, r4).alias("value"))


MD_HEAD = ["Compound", "Source", "Kind"]


@query("s7_markdown_tables", """SELECT p_partkey AS path, p_name || '|' || p_type AS compound, p_brand AS source, p_type AS kind FROM part WHERE p_partkey % 10 NOT IN (3, 7) UNION ALL SELECT p_partkey, p_name, '', '' FROM part WHERE p_partkey % 10 NOT IN (3, 7)""")
def s7(spark, d):
    rows, _ = sc.parse_markdown_tables(_markdown(spark, d), MD_HEAD, "Q1")
    return rows.select("path", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("compound", "source", "kind"))])


@query("s7_markdown_errors", """SELECT p_partkey AS path, CASE p_partkey % 10 WHEN 3 THEN 'HEADER_MISMATCH' ELSE 'MISSING_SEPARATOR' END AS reason FROM part WHERE p_partkey % 10 IN (3, 7)""")
def s7_errors(spark, d):
    return sc.parse_markdown_tables(_markdown(spark, d), MD_HEAD, "Q1")[1]


@query("s8_section_units")
def s8(spark, d):
    """A walk over nested markup has no SQL form; header fields below do, and small pages are checked in the tests."""
    return sc.extract_units(table(spark, d, "pages", "page_id", "html"))


@query("s8_header_fields", r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?i)<p>')) AS paragraphs FROM pages""")
def s8_header(spark, d):
    return sc.header_fields(table(spark, d, "pages", "page_id", "html"))


def _table_cells(spark, d):
    """A table per part: a spanning title row, a header row with a blank, two data rows."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    cell = lambda r, k, s, t: F.struct(F.lit(r).alias("row_no"), F.lit(k).alias("col_no"), F.lit(s).alias("span"), t.alias("text"))
    cells = F.array(cell(0, 0, 1, F.lit("Compound")), cell(0, 1, 2, c("p_type")), cell(1, 0, 1, F.lit("Compound")), cell(1, 1, 1, F.lit("EC")), cell(1, 2, 1, F.lit(" ")),
                    cell(2, 0, 1, c("p_name")), cell(2, 1, 1, c("p_size").cast("string")), cell(2, 2, 1, F.lit("ND")), cell(3, 0, 1, F.lit("control")), cell(3, 1, 1, F.lit("n.a.")), cell(3, 2, 1, F.lit("> 5")))
    return p.select(c("p_partkey").alias("table_id"), F.explode(cells).alias("x")).select("table_id", "x.*")


@query("s9_table_headers", """SELECT p_partkey AS table_id, 0 AS col_no, 'Compound' AS header FROM part UNION ALL SELECT p_partkey, n, p_type || ' — EC' FROM part, (SELECT unnest([1, 2]) AS n)""")
def s9(spark, d):
    return sc.assemble_tables(_table_cells(spark, d))[0]


@query("s9_table_cells", """SELECT p_partkey AS table_id, unnest([2,2,2,3,3,3]) AS row_no, unnest([0,1,2,0,1,2]) AS col_no, unnest([p_name, p_size::VARCHAR, 'ND', 'control', 'n.a.', '> 5']) AS text FROM part""")
def s9_cells(spark, d):
    return sc.assemble_tables(_table_cells(spark, d))[1]


def _papers(spark, d):
    """A paper per part: a table figure with stacked headers and footnotes, for some a figure without rows, a bare table or broken markup."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    k, size = c("p_partkey"), c("p_size").cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    figure = text('<figure type="table"><head>Table 1</head><label> 1 </label><figDesc>Activity of ', c("p_name"), '</figDesc><table><row><cell>Compound</cell><cell cols="2">', c("p_type"),
                  '</cell></row><row><cell/><cell>EC50</cell><cell>in ', c("p_brand"), '</cell></row><row><cell>', c("p_name"), '</cell><cell>', size,
                  '.5 ± 0.1</cell></row><row><cell>control</cell><cell>&lt; 5</cell><cell>n.d.</cell></row></table><note><s>Mean of ', size, '.</s><s> </s><s>At  25 C.</s></note></figure>')
    empty = F.when(k % 7 == 0, '<figure type="Table"><head>Scan</head></figure>').otherwise("")
    bare = F.when(k % 5 == 0, text("<table><row><cell>a</cell><cell>b</cell></row><row><cell cols='x'>", c("p_brand"), "</cell></row></table>")).otherwise("")
    end = F.when(k % 11 == 0, "</text>").otherwise("</text></TEI>")
    return p.select(k.alias("paper"), text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text>', bare, figure, empty, end).alias("markup"))


def _tables(spark, d):
    return mt.with_headers(mt.parse_tables(_papers(spark, d), "paper", "markup"))


SQL_TABLES = """sound AS (SELECT *, p_partkey AS paper, 'T' || (CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE 2 END) AS bare FROM part WHERE p_partkey % 11 <> 0)"""


@query("s9_markup_tables", sql("""SELECT paper, 'T1' AS table_ref, '1' AS label, 'Table 1 Activity of ' || p_name AS caption, concat_ws('|', 'Compound', p_type || ' — EC50', p_type || ' — in ' || p_brand) AS headers,
      'Mean of ' || p_size || '.|At 25 C.' AS footnotes FROM sound
    UNION ALL SELECT paper, 'T2', NULL, 'Scan', '', '' FROM sound WHERE paper % 7 = 0 UNION ALL SELECT paper, bare, NULL, NULL, 'a|b', '' FROM sound WHERE paper % 5 = 0""", extra=SQL_TABLES))
def s9_markup(spark, d):
    return _tables(spark, d).where("table_ref IS NOT NULL").select(
        "paper", "table_ref", "label", "caption", F.array_join("headers", "|").alias("headers"), F.array_join("footnotes", "|").alias("footnotes"))


@query("s9_markup_cells", sql("""SELECT paper, 'T1' AS table_ref, row_no, col_no, CASE col_no WHEN 0 THEN 'Compound' WHEN 1 THEN p_type || ' — EC50' ELSE p_type || ' — in ' || p_brand END AS header,
      CASE WHEN row_no = 0 THEN CASE col_no WHEN 0 THEN p_name WHEN 1 THEN p_size || '.5 ± 0.1' ELSE '' END ELSE CASE col_no WHEN 0 THEN 'control' WHEN 1 THEN '< 5' ELSE 'n.d.' END END AS text
      FROM sound, (VALUES (0), (1)) r(row_no), (VALUES (0), (1), (2)) k(col_no)
    UNION ALL SELECT paper, bare, 0, col_no, CASE col_no WHEN 0 THEN 'a' ELSE 'b' END, CASE col_no WHEN 0 THEN p_brand ELSE '' END FROM sound, (VALUES (0), (1)) k(col_no) WHERE paper % 5 = 0""", extra=SQL_TABLES))
def s9_markup_cells(spark, d):
    return mt.data_cells(_tables(spark, d), "paper")


@query("s9_backfill_counts", """SELECT count(*) AS scanned, count(*) FILTER (p_partkey % 11 <> 0) AS done, count(*) FILTER (p_partkey % 11 = 0) AS failed,
    CAST(sum(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 + (p_partkey % 7 = 0)::INT + (p_partkey % 5 = 0)::INT END) AS BIGINT) AS tables FROM part""")
def s9_counts(spark, d):
    return mt.backfill_counts(mt.parse_tables(_papers(spark, d), "paper", "markup"), "paper")


@query("s10_export_clip", """SELECT doc_id, length(substr(text || text || text, 1, 32767)) AS chars FROM documents""")
def s10(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").withColumn("text", F.concat("text", "text", "text"))
    return sc.clip_cells(t, ["text"]).select("doc_id", F.length("text").alias("chars"))


# ---- pages of documents --------------------------------------------------------------------------
PAGE = """pg0 AS (SELECT conv_id AS document_id, turn AS page_number, CASE turn % 4 WHEN 0 THEN '12 3 x' || chr(10) || '7 * y' || chr(10) || 'Phytophthora activity' WHEN 1 THEN 'molecular weight of 12 and 7' WHEN 2 THEN 'Abstract compound on late blight' ELSE 'plain' END AS text,
    turn % 8 = 0 AS tbl, role = 'system' AS method, turn % 5 = 4 AS result, turn % 6 = 3 AS claims, turn = 6 AS eligible FROM conversations),
 pg1 AS (SELECT *, CASE turn4 WHEN 0 THEN 4+3 WHEN 1 THEN 0 WHEN 2 THEN 2+4+2 ELSE 0 END + CASE WHEN eligible THEN 5 ELSE 0 END + CASE WHEN method THEN 9 ELSE 0 END + CASE WHEN tbl THEN 9 ELSE 0 END - CASE WHEN claims AND NOT eligible AND NOT tbl THEN 3 ELSE 0 END AS score0,
    turn4 = 2 AS abs, turn4 = 1 AND NOT tbl AND document_id IN (SELECT document_id FROM pg0 WHERE tbl) AS cmap FROM (SELECT *, page_number % 4 AS turn4 FROM pg0)),
 pg2 AS (SELECT *, score0 + CASE WHEN cmap THEN 8 ELSE 0 END AS score, CASE WHEN eligible THEN 110 WHEN method THEN 100 WHEN tbl THEN 90 WHEN cmap THEN 80 WHEN abs THEN 50 WHEN claims THEN 10 ELSE 20 END AS priority,
    eligible OR method OR result OR (abs AND score0 >= 6) OR cmap OR EXISTS (SELECT 1 FROM pg0 y WHERE y.document_id=pg1.document_id AND ((y.tbl AND abs(y.page_number-pg1.page_number)<=1) OR (y.method AND abs(y.page_number-pg1.page_number)<=2))) AS sel FROM pg1)"""
PAGE = PAGE.replace("abs(y.page_number-pg1.page_number)", "@(y.page_number-pg1.page_number)")


def _pages(spark, d):
    t = table(spark, d, "conversations", "conv_id", "turn", "role")
    k = c("turn") % 4
    text = (F.when(k == 0, "12 3 x\n7 * y\nPhytophthora activity").when(k == 1, "molecular weight of 12 and 7").when(k == 2, "Abstract compound on late blight").otherwise("plain"))
    return t.select(c("conv_id").alias("document_id"), c("turn").alias("page_number"), text.alias("text"), (c("turn") % 8 == 0).alias("table"), (c("role") == "system").alias("method"),
                    (c("turn") % 5 == 4).alias("result"), (c("turn") % 6 == 3).alias("claims"), (c("turn") == 6).alias("eligible"))


@query("d17_page_triage", sql("SELECT document_id, page_number, CAST(score AS INT) AS score, priority, sel AND row_number() OVER (PARTITION BY document_id, sel ORDER BY priority DESC, score DESC, page_number) <= 40 AS selected FROM pg2", extra=PAGE))
def d17(spark, d):
    return do.triage(_pages(spark, d)).select("document_id", "page_number", "score", "priority", "selected")


@query("f19_page_score", sql("SELECT document_id, page_number, CAST(score0 AS INT) AS score FROM pg1", extra=PAGE))
def f19(spark, d):
    from litquarry.functions.pages import page_score
    p = _pages(spark, d)
    return p.select("document_id", "page_number", page_score(c("text"), c("eligible"), c("method"), c("table"), c("claims")).alias("score"))


@query("t7_trim_pages", sql("SELECT document_id, page_number, sel AND row_number() OVER (PARTITION BY document_id, sel ORDER BY priority DESC, score DESC, page_number) <= 3 AS selected FROM pg2", extra=PAGE))
def t7(spark, d):
    return do.trim_pages(do.triage(_pages(spark, d)), 3).select("document_id", "page_number", "selected")


@query("d18_evidence_bundles", sql("""SELECT document_id, pages, methods, results, tables, array_to_string(list_filter([CASE WHEN methods=0 THEN 'METHOD_CONTEXT' END, CASE WHEN tables=0 AND rd>0 THEN 'SELECTED_TABLE_NOT_RECOVERED' END, CASE WHEN tables=0 AND results=0 THEN 'RESULT_CONTEXT' END], lambda x: x IS NOT NULL), ',') AS missing,
    CASE WHEN tables=0 AND act>0 THEN 'UNRESOLVED' WHEN tables=0 AND results=0 THEN 'NO_EVIDENCE_FOUND' ELSE 'EVIDENCE_FOUND' END AS outcome, CASE WHEN methods>0 AND NOT (tables=0 AND rd>0) AND NOT (tables=0 AND results=0) THEN 'COMPLETE' ELSE 'REVIEW_REQUIRED' END AS status FROM
    (SELECT document_id, count(*) FILTER (sel) AS pages, count(*) FILTER (sel AND method) AS methods, count(*) FILTER (sel AND result) AS results, count(*) FILTER (tbl AND document_id % 2 = 0) AS tables, count(*) FILTER (page_number % 3 = 0) AS rd, count(*) FILTER (page_number % 3 = 0 AND claims) AS act FROM pg2 GROUP BY 1) WHERE pages > 0""", extra=PAGE))
def d18(spark, d):
    p = do.triage(_pages(spark, d))
    cand = p.where("page_number % 3 = 0").select("document_id", F.when(c("claims"), "ACTIVITY").otherwise("UNKNOWN").alias("kind"), F.lit(True).alias("selected_for_read"))
    return do.bundles(p, p.where("table AND document_id % 2 = 0").select("document_id"), cand).withColumn("missing", F.array_join("missing", ","))


@query("w12_section_roles")
def w12(spark, d):
    """The carried section state is a scan; its transitions are checked on small documents in the tests."""
    t = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    k = c("turn")
    head = (F.when(c("role") == "system", "Background of things").when(k % 5 == 1, "TEST A Phytophthora inoculated").when(k % 5 == 2, "Results: activity shown").when(k % 5 == 3, "Claims follow").otherwise(c("text")))
    return do.section_roles(t.select(c("conv_id").alias("document_id"), k.cast("int").alias("page_number"), F.lit(0).alias("paragraph"), head.alias("text"))).select("document_id", "page_number", "role", "assay_id", "eligible")


@query("f14_legend_resolution", """SELECT document_id, 'P. ' || w AS code, 'Phytophthora ' || w AS meaning, document_id || ':1' AS chunk_id FROM (SELECT o_orderkey AS document_id, CASE o_orderkey % 3 WHEN 0 THEN 'capsici' WHEN 1 THEN 'infestans' ELSE 'sojae' END AS w FROM orders WHERE o_orderkey % 4 <> 0)""")
def f14(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    k = c("o_orderkey")
    w = F.when(k % 3 == 0, "capsici").when(k % 3 == 1, "infestans").otherwise("sojae")
    surf = o.select(k.alias("document_id"), F.concat(F.lit("Cmpd vs P. "), w, F.lit(" and P."), w).alias("text"))
    mk = lambda i, t: o.select(k.alias("document_id"), F.lit(i).alias("chunk_index"), F.concat_ws(":", k, F.lit(i)).alias("chunk_id"), t.alias("text"))
    ch = mk(0, F.lit("nothing here")).unionByName(mk(1, F.when(k % 4 == 0, "no species").otherwise(F.concat(F.lit("We grew Phytophthora "), w, F.lit(" on agar."))))).unionByName(
        mk(2, F.when(k % 4 == 0, "still none").otherwise(F.concat(F.lit("Later Pythium "), w, F.lit(" too.")))))
    return do.resolve_legend(surf, ch)


@query("f14_explicit_codes", """SELECT o_orderkey AS document_id, 'Pc' AS code, 'Phytophthora capsici' AS meaning, o_orderkey || ':0' AS chunk_id FROM orders""")
def f14_codes(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    ch = o.select(c("o_orderkey").alias("document_id"), F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("Codes: Pc = Phytophthora capsici.").alias("t")), F.struct(F.lit(1).alias("i"), F.lit("Pc = Pythium other").alias("t")))).alias("x"))
    return do.explicit_legend(ch.select("document_id", c("x.i").alias("chunk_index"), F.concat_ws(":", "document_id", "x.i").alias("chunk_id"), c("x.t").alias("text")))


# ---- tables read twice, audits -------------------------------------------------------------------
def _read(spark, d, second: bool):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size")
    k = c("p_partkey")
    name = F.when(k % 6 == 0, F.concat(c("p_name"), F.lit("!"))).otherwise(F.concat(F.upper("p_name"), F.lit(" "))) if second else c("p_name")
    cells = F.array(F.struct(F.lit(0).alias("col_no"), name.alias("text")), F.struct(F.lit(1).alias("col_no"), c("p_brand").alias("text")))
    t = p.select(c("p_size").alias("table_id"), k.alias("row_no"), F.explode(cells).alias("x")).select("table_id", "row_no", "x.*")
    return t.where("NOT (row_no % 50 = 1 AND col_no = 1)") if second else t


@query("d19_double_read_audit", """SELECT p_size AS table_id, count(*) FILTER (p_partkey % 6 = 0) + count(*) FILTER (p_partkey % 50 = 1) AS differences, 2*count(*) AS cells, CASE WHEN count(*) FILTER (p_partkey % 6 = 0 OR p_partkey % 50 = 1) = 0 THEN 'VERIFIED' ELSE 'REVIEW_REQUIRED' END AS status FROM part GROUP BY 1""")
def d19(spark, d):
    return do.compare_reads(_read(spark, d, False), _read(spark, d, True))


@query("d20_row_audit", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 12 = 1 THEN 'MISSING' WHEN p_partkey % 12 = 2 THEN 'EXTRA' WHEN p_partkey % 12 = 3 THEN 'VALUE_MISMATCH' WHEN p_partkey % 12 = 4 THEN 'RATIO_MISMATCH' ELSE 'MATCH' END AS status FROM part) GROUP BY 1""")
def d20(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size")
    k, size = c("p_partkey"), c("p_size").cast("string")
    native = p.where(k % 12 != 2).select(k.alias("table_id"), F.lit("Row A").alias("row_key"), size.alias("value"), F.lit("1:2").alias("ratio"))
    got = p.where(k % 12 != 1).select(k.alias("table_id"), F.lit("row  a").alias("row_key"), F.when(k % 12 == 3, F.concat(F.lit("> "), size)).otherwise(F.concat(size, F.lit(" ± 0.1"))).alias("value"),
                                      F.when(k % 12 == 4, "2:1").otherwise("1:2").alias("ratio"))
    return do.audit_rows(native, got).groupBy("status").agg(F.count("*").alias("n"))


@query("d21_metadata_backfill", r"""SELECT page_id AS document_id, CASE WHEN page_id % 4 = 0 THEN '1999' WHEN page_id % 3 = 0 THEN '2001' WHEN page_id % 2 = 0 THEN '2002' END AS year, CASE WHEN page_id % 4 = 0 THEN 'existing' WHEN page_id % 3 = 0 THEN 'markup' WHEN page_id % 2 = 0 THEN 'registry' END AS year_source,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS keywords, 'markup' AS keywords_source FROM pages""")
def d21(spark, d):
    return _filled(spark, d)


def _filled(spark, d):
    p = table(spark, d, "pages", "page_id", "html")
    k = c("page_id")
    base = p.select(k.alias("document_id"), F.when(k % 4 == 0, 1999).alias("year"), F.lit(" ").alias("keywords"))
    markup = p.select(k.alias("document_id"), F.when(k % 3 == 0, 2001).alias("year"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("keywords"))
    registry = p.where("page_id % 2 = 0").select(k.alias("document_id"), F.lit(2002).alias("year"), F.lit("other").alias("keywords"))
    return do.backfill(base, [("markup", markup), ("registry", registry)], ["year", "keywords"])


@query("d21_backfill_counters", """SELECT CASE WHEN page_id % 4 = 0 THEN 'existing' WHEN page_id % 3 = 0 THEN 'markup' WHEN page_id % 2 = 0 THEN 'registry' ELSE 'missing' END AS source, count(*) AS documents FROM pages GROUP BY 1""")
def d21_counters(spark, d):
    return do.backfill_counters(_filled(spark, d), "year")


# ---- discovery and review ------------------------------------------------------------------------
@query("d22_extraction_checks", sql("""SELECT document_id, question_no, status, CASE WHEN status='OK' THEN instr(text, q) - 1 END AS start_offset FROM (SELECT document_id, question_no, text, q, CASE WHEN question_no = 2 THEN 'DUPLICATE_QUESTION' WHEN trim(q) = '' THEN 'EMPTY_QUOTE' WHEN instr(text, q) = 0 THEN 'NOT_FOUND'
    WHEN instr(substr(text, instr(text, q) + 1), q) > 0 THEN 'AMBIGUOUS' ELSE 'OK' END AS status FROM (SELECT document_id, text, n AS question_no, CASE n WHEN 3 THEN title || '~' ELSE split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) END AS q FROM docs, (SELECT unnest([1, 2, 3]) AS n)))""", "docs"))
def d22(spark, d):
    t = docs(spark, d)
    w = lambda n: F.split_part(c("text"), F.lit(" "), F.lit(n))
    q = F.concat_ws(" ", w(2), w(3))
    qs = F.array(F.struct(F.lit(1).alias("n"), F.lit("What is seen?").alias("question"), q.alias("quote")), F.struct(F.lit(2).alias("n"), F.lit("what is SEEN?").alias("question"), q.alias("quote")),
                 F.struct(F.lit(3).alias("n"), F.lit("Why?").alias("question"), F.concat("title", F.lit("~")).alias("quote")))
    e = t.select("document_id", F.explode(qs).alias("x")).select("document_id", c("x.n").alias("question_no"), "x.question", "x.quote")
    return do.check_extractions(e, t)


@query("d22_embedding_status", """SELECT o_custkey AS document_id, count(*) AS members, CASE WHEN count(*) FILTER (o_orderstatus='P') = 0 THEN 'READY' WHEN count(*) FILTER (o_orderstatus<>'P') = 0 THEN 'EMBEDDING_FAILED' ELSE 'PARTIAL_EMBEDDING' END AS status FROM orders GROUP BY 1""")
def d22_embedding(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return do.embedding_status(o.select(c("o_custkey").alias("document_id"), c("o_orderkey").alias("member_id"), (c("o_orderstatus") == "P").alias("failed")))


@query("d22_cluster_status", """SELECT label AS cluster, count(*) AS members, CASE label % 5 WHEN 0 THEN CASE WHEN label = 0 THEN 'PARTIAL' ELSE 'FAILED' END WHEN 1 THEN 'NEEDS_SPLIT' WHEN 2 THEN 'NEEDS_SPLIT' ELSE 'READY' END AS status FROM embeddings GROUP BY label""")
def d22_cluster(spark, d):
    return _cluster_status(spark, d)[0]


def _cluster_status(spark, d):
    m = table(spark, d, "embeddings", "vec_id", "label").select(c("label").alias("cluster"), c("vec_id").alias("member_id"))
    parts = m.select("cluster").distinct().select("cluster", F.explode(F.when(c("cluster") % 5 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("part_no")).withColumn(
        "status", F.when(c("cluster") % 5 == 0, "FAILED").when(c("cluster") % 5 == 2, "NEEDS_SPLIT").otherwise("READY"))
    return do.cluster_status(m, parts, m.where("member_id % 3 = 0 AND cluster <> 5"))


@query("d22_unrepresented_members", "SELECT label AS cluster, vec_id AS member_id FROM embeddings WHERE NOT (vec_id % 3 = 0 AND label <> 5)")
def d22_unrepresented(spark, d):
    return _cluster_status(spark, d)[1]


def _sheet(spark, d):
    t = table(spark, d, "labels")
    items = t.select(F.when(c("quality") == 1, "question").otherwise("cluster").alias("kind"), F.lit("abstract").alias("mode"), c("doc_id").cast("string").alias("document_id"),
                     F.concat(F.lit("i"), c("doc_id").cast("string")).alias("item_id"), F.lit("READY").alias("status"), F.when(c("doc_id") % 2 == 0, "=SUM(1)").otherwise("text").alias("text"))
    return do.review_sheet(items)


SHEET = """sh AS (SELECT doc_id, CASE WHEN quality=1 THEN 'question' ELSE 'cluster' END AS kind, CASE WHEN doc_id % 2 = 0 THEN '''=SUM(1)' ELSE 'text' END AS text FROM labels),
 sh2 AS (SELECT *, sha256('{"document_id":"' || doc_id || '","item_id":"i' || doc_id || '","kind":"' || kind || '","mode":"abstract","status":"READY","text":"' || text || '"}') AS row_id FROM sh)"""


@query("d23_review_sheet", sql("SELECT row_id, kind, 'abstract' AS mode, doc_id::VARCHAR AS document_id, 'i' || doc_id AS item_id, 'READY' AS status, text FROM sh2", extra=SHEET))
def d23(spark, d):
    return _sheet(spark, d)


def _review(spark, d):
    s = _sheet(spark, d)
    n = c("document_id").cast("long")
    prev = s.where(n % 3 > 0).withColumn("text", F.when(n % 7 == 1, "edited").otherwise(c("text"))).withColumn("supported", F.when(n % 4 == 1, "no").otherwise("YES"))
    alien = s.where(n % 3 == 1).withColumn("row_id", F.concat(F.lit("x"), "document_id")).withColumn("supported", F.lit("yes"))
    return do.merge_review(s, prev.unionByName(alien), ["supported"])


@query("d23_review_merge", sql("SELECT row_id, doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 7 <> 1 THEN CASE WHEN doc_id % 4 = 1 THEN 'no' ELSE 'YES' END END AS supported FROM sh2", extra=SHEET))
def d23_merge(spark, d):
    return _review(spark, d)[0].select("row_id", "document_id", "supported")


@query("d23_tampered_rows", sql("SELECT row_id, 'FIXED_FIELD_CHANGED' AS reason FROM sh2 WHERE doc_id % 3 > 0 AND doc_id % 7 = 1 UNION ALL SELECT 'x' || doc_id, 'UNKNOWN_ROW' FROM sh2 WHERE doc_id % 3 = 1", extra=SHEET))
def d23_tampered(spark, d):
    return _review(spark, d)[1]


RATES = f"""rt AS (SELECT 'm' || (doc_id % 2) AS mode, quality, CASE WHEN doc_id % 2 = 0 OR doc_id % 9 > 0 THEN CASE WHEN toxic = 0 AND doc_id % 4 > 0 THEN 'yes' ELSE 'no' END END AS a FROM labels),
 rr AS (SELECT mode, quality, count(*) AS total, count(a) AS reviewed, count(*) FILTER (a='yes') AS correct FROM rt GROUP BY ALL),
 rates AS (SELECT *, total-reviewed AS pending, CASE WHEN total=reviewed THEN {ratio_sql('correct','total')} END AS value, CASE WHEN reviewed>0 THEN {ratio_sql('correct','reviewed')} END AS reviewed_subset_value FROM rr)"""


def _rates(spark, d):
    n = c("doc_id")
    a = F.when((n % 2 == 0) | (n % 9 > 0), F.when((c("toxic") == 0) & (n % 4 > 0), " Yes").otherwise("no")).otherwise(" ")
    t = table(spark, d, "labels").select(F.concat(F.lit("m"), (n % 2).cast("string")).alias("mode"), "quality", a.alias("supported"))
    return do.review_rates(t, ["mode", "quality"], "supported", ["yes"])


@query("a25_review_rates", sql("SELECT * FROM rates", extra=RATES))
def a25(spark, d):
    return _rates(spark, d)


@query("a25_rate_delta", sql("SELECT quality, max(value) FILTER (mode='m1') - max(value) FILTER (mode='m0') AS b_minus_a FROM rates GROUP BY quality", extra=RATES))
def a25_delta(spark, d):
    return do.rate_delta(_rates(spark, d), "mode", "m0", "m1", ["quality"])


@query("a25_coverage", f"""SELECT *, CASE WHEN reviewed_documents = total_documents AND known_reference_questions > 0 THEN {ratio_sql('covered', 'known_reference_questions')} END AS value FROM (SELECT 'm' || (doc_id % 2) AS mode, count(*) AS total_documents, CAST(sum(q) AS BIGINT) AS known_reference_questions,
    CAST(sum(coalesce(cv, 0)) AS BIGINT) AS covered, count(*) FILTER (cv IS NOT NULL OR q = 0) AS reviewed_documents FROM (SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS q, CASE WHEN doc_id % 2 = 0 OR doc_id % 9 > 0 THEN CAST((doc_id % 4) // 2 AS BIGINT) END AS cv FROM labels) GROUP BY 1)""")
def a25_coverage(spark, d):
    n = c("doc_id")
    t = table(spark, d, "labels", "doc_id")
    rows = t.select(F.concat(F.lit("m"), (n % 2).cast("string")).alias("mode"), n.alias("document_id"), F.when((n % 2 == 0) | (n % 9 > 0), F.floor((n % 4) / 2)).alias("covered"))
    return do.review_coverage(rows, t.select(n.alias("document_id"), (n % 4).alias("questions")))


@query("x3_usage_windows", """SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type AS phase, 'm' || (user_id % 3) AS model, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CAST(floor(value*100+0.5) AS BIGINT)) AS BIGINT) AS elapsed_ms FROM events GROUP BY ALL""")
def x3(spark, d):
    """Batch run of the streaming aggregation; the streaming run is compared with it in the tests."""
    return usage_stream(step_events(table(spark, d, "events")))
