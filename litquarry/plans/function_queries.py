"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions import cells as ce, core, identifiers as ids, pages as pg
from litquarry.operators import columns as co
from litquarry.plans.registry import query
from litquarry.plans.views import chunks, docs, r_sql, sql
from litquarry.sources.tables import table

c = F.col


def named_parts(parts):
    """Compound naming inputs (original, standard, category, description, structure) from parts."""
    k, size = c("p_partkey"), c("p_size").cast("string")
    original = (F.when(k % 5 == 0, F.concat(F.lit("Compound  No. "), size, F.lit("b"))).when(k % 5 == 1, F.concat(size, F.lit("a")))
                .when(k % 5 == 2, F.concat(F.lit("Ethanol extract of "), c("p_name")))
                .when(k % 5 == 3, F.concat(c("p_name"), F.lit(" ("), size, F.lit(")"))).otherwise(F.concat(c("p_name"), F.lit(" oil"))))
    return parts.select(
        "p_partkey", original.alias("original"), F.when(k % 5 == 3, F.concat(c("p_type"), F.lit(" (2) "))).alias("standard"),
        F.when(k % 2 == 0, "Plant source").otherwise(c("p_brand")).alias("category"),
        F.when(k % 3 == 0, F.concat(c("p_name"), F.lit(", leaf  crude"))).alias("descr"), c("p_type").alias("structure"))



# ---- DOI, keys, ids ------------------------------------------------------------------------------
RAW = """raw AS (SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN ' https://doi.org/10.' || (1000 + doc_id) || '/AB.' || source || '.,'
    WHEN 1 THEN 'doi: 10.' || (1000 + doc_id) || '/x(' || n_chars || ');'
    WHEN 2 THEN '10.' || (1000 + doc_id) || '_Paper-' || lang || '.PDF' ELSE lang || ' ;' END AS ref FROM documents)"""
DOI_SQL = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"


def _refs(spark, d):
    t = table(spark, d, "documents", "doc_id", "source", "lang", "n_chars")
    no = (c("doc_id") + 1000).cast("string")
    kind = c("doc_id") % 4
    return t.select("doc_id", F.when(kind == 0, F.concat(F.lit(" https://doi.org/10."), no, F.lit("/AB."), c("source"), F.lit(".,")))
                    .when(kind == 1, F.concat(F.lit("doi: 10."), no, F.lit("/x("), c("n_chars").cast("string"), F.lit(");")))
                    .when(kind == 2, F.concat(F.lit("10."), no, F.lit("_Paper-"), c("lang"), F.lit(".PDF")))
                    .otherwise(F.concat(c("lang"), F.lit(" ;"))).alias("ref"))


@query("f1_doi_normalise", sql(rf"""SELECT doc_id,
    nullif(trim(lower(regexp_replace(CASE WHEN found <> '' THEN found ELSE bare END, '[\.,;:]+$', ''))), '') AS doi,
    CASE WHEN regexp_extract(ref, '{DOI_SQL}') <> '' THEN
      lower(regexp_replace(regexp_extract(ref, '{DOI_SQL}'), '[\.,;:]+$', '')) END AS first_doi,
    CASE WHEN regexp_extract(stem, '{DOI_SQL}') <> '' THEN lower(regexp_replace(regexp_extract(stem, '{DOI_SQL}'), '[.,;:]+$', ''))
      WHEN length(regexp_replace(regexp_extract(stem, '(10\.\d{{4,9}})_(\S+)', 2), '[.,;:]+$', '')) >= 3
      THEN lower(regexp_extract(stem, '(10\.\d{{4,9}})_(\S+)', 1) || '/' ||
        regexp_replace(regexp_extract(stem, '(10\.\d{{4,9}})_(\S+)', 2), '[.,;:]+$', '')) END AS file_doi
    FROM (SELECT *, regexp_extract(bare, '{DOI_SQL}') AS found, regexp_replace(trim(regexp_replace(ref, '\s+', ' ', 'g')),
      '(?i)\.pdf$', '') AS stem FROM
      (SELECT *, trim(replace(replace(trim(ref), 'https://doi.org/', ''), 'doi:', '')) AS bare FROM raw))""", extra=RAW))
def f1(spark, d):
    return _refs(spark, d).select("doc_id", ids.doi_normalise("ref").alias("doi"), ids.first_doi("ref").alias("first_doi"),
                                  ids.doi_from_filename("ref").alias("file_doi"))


@query("f2_key_normalise", r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('- ' || p_name || ' #' || p_brand || '!')),
    '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM part""")
def f2(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    raw = F.concat(F.lit("- "), c("p_name"), F.lit(" #"), c("p_brand"), F.lit("!"))
    return p.select("p_partkey", ids.key_normalise(raw).alias("key"))


@query("f3_quote_in_chunk", sql("""SELECT chunk_id, contains(trim(regexp_replace(text, '\\s+', ' ', 'g')),
    trim(regexp_replace(CASE WHEN chunk_index % 2 = 0 THEN replace(text, ' ', '  ') ELSE text || '!x' END, '\\s+', ' ', 'g')))
    AS found FROM chunks""", "lines", "chunks"))
def f3(spark, d):
    q = F.when(c("chunk_index") % 2 == 0, F.replace(c("text"), F.lit(" "), F.lit("  "))).otherwise(F.concat(c("text"), F.lit("!x")))
    return chunks(spark, d).select("chunk_id", ce.quote_in(c("text"), q).alias("found"))


@query("f4_row_fingerprint", """SELECT p_partkey, sha256('Q1' || chr(31) || lower(concat_ws(chr(31), p_name, p_brand, p_type)))
    AS question_fp, sha256(lower(concat_ws(chr(31), p_name, p_brand, p_type))) AS table_fp FROM part""")
def f4(spark, d):
    cells = F.array("p_name", "p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", ce.row_fingerprint(F.lit(" q1"), cells).alias("question_fp"),
                                          ce.table_row_fingerprint(cells).alias("table_fp"))


@query("f5_name_uuid", sql(
    """SELECT chunk_id, substr(h,1,8)||'-'||substr(h,9,4)||'-3'||substr(h,14,3)||'-'||
    translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr(h,18,3)||'-'||substr(h,21,12) AS uuid
    FROM (SELECT chunk_id, md5(chunk_id) AS h FROM chunks)""", "lines", "chunks"))
def f5(spark, d):
    return chunks(spark, d).select("chunk_id", ids.name_uuid("chunk_id").alias("uuid"))


@query("f6_token_estimate", r"""SELECT doc_id, CASE WHEN trim(text)='' THEN 0 ELSE
    greatest(1, CAST(ceil((length(text)-length(w))/4.0) AS INT) + CAST(length(w) AS INT)) END AS tokens FROM
    (SELECT doc_id, text, regexp_replace(text, '[\x00-\x7F]', '', 'g') AS w FROM documents)""")
def f6(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", core.token_estimate("text").alias("tokens"))


TOKS = r"list_distinct(list_filter(string_split_regex({}, '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+'), lambda t: t <> ''))"


def similarity_sql(a: str, b: str, kind: str) -> str:
    """Oracle form of the cell similarity over already folded cells."""
    num = r"regexp_extract({}, '[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?')"
    na, nb = f"TRY_CAST({num.format(a)} AS DOUBLE)", f"TRY_CAST({num.format(b)} AS DOUBLE)"
    sc = f"greatest(abs({na}),abs({nb}))"
    ta, tb = TOKS.format(a), TOKS.format(b)
    return f"""CASE WHEN {a}={b} THEN 1.0 WHEN {a}='' OR {b}='' THEN 0.0
      WHEN {kind}='numeric' AND {na} IS NOT NULL AND {nb} IS NOT NULL THEN
        CASE WHEN {sc}=0 THEN 1.0 WHEN abs({na}-{nb})/{sc}<=0.05 THEN 1.0 WHEN abs({na}-{nb})/{sc}<=0.2 THEN 0.6 ELSE 0.0 END
      WHEN len({ta})=0 OR len({tb})=0 THEN 0.0
      ELSE len(list_intersect({ta},{tb}))::DOUBLE/len(list_distinct(list_concat({ta},{tb}))) END"""


@query("f7_cell_similarity", f"""SELECT p_partkey, {r_sql(similarity_sql("a","b","'text'"))} AS text_sim,
    {r_sql(similarity_sql("x","y","'numeric'"))} AS num_sim, 'numeric' AS num_kind, 'text' AS text_kind FROM
    (SELECT p_partkey, lower(p_name || ' ' || p_type) AS a, lower(p_type || '  ' || p_brand).replace('  ',' ') AS b,
     'ec50 ' || p_size || ' mg/l' AS x, CASE WHEN p_size % 3 = 0 THEN '~' || (p_size + 2) ELSE 'about ' || (p_size * 1.04) END AS y
     FROM part)""")
def f7(spark, d):
    a, b = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws("  ", "p_type", "p_brand")
    x = F.concat(F.lit("EC50 "), c("p_size").cast("string"), F.lit(" mg/L"))
    y = F.when(c("p_size") % 3 == 0, F.concat(F.lit("~"), (c("p_size") + 2).cast("string"))).otherwise(
        F.concat(F.lit("about "), (c("p_size") * F.lit(1.04).cast("decimal(3,2)")).cast("string")))
    nk, tk = ce.field_kind(F.lit("Activity data")), ce.field_kind(F.lit("Compound"))
    return table(spark, d, "part").select(
        "p_partkey", core.round_half_up(ce.cell_similarity(a, b, tk)).alias("text_sim"),
        core.round_half_up(ce.cell_similarity(x, y, nk)).alias("num_sim"), nk.alias("num_kind"), tk.alias("text_kind"))


NAMES = """names AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Compound  No. ' || p_size || 'b' WHEN 1 THEN p_size || 'a'
    WHEN 2 THEN 'Ethanol extract of ' || p_name WHEN 3 THEN p_name || ' (' || p_size || ')' ELSE p_name || ' oil' END AS original,
    CASE WHEN p_partkey % 5 = 3 THEN p_type || ' (2) ' END AS standard,
    CASE WHEN p_partkey % 2 = 0 THEN 'Plant source' ELSE p_brand END AS category,
    CASE WHEN p_partkey % 3 = 0 THEN p_name || ', leaf  crude' END AS descr, p_type AS structure FROM part)"""


@query("f8_name_kind_and_key", sql(r"""SELECT p_partkey, kind, CASE kind WHEN 'LOCAL_LABEL' THEN 'local:' || p_partkey || ':' ||
      regexp_replace(lower(trim(regexp_replace(original, '\s*\(\s*\d+\s*\)\s*$', ''))), '\s+', ' ', 'g')
    WHEN 'NATURAL_EXTRACT' THEN 'extract:' || regexp_replace(lower(concat_ws('|', species, part, solvent)), '\s+', ' ', 'g')
    ELSE 'compound:' || regexp_replace(lower(coalesce(nullif(trim(regexp_replace(trim(standard), '\s*\(\s*\d+\s*\)\s*$', '')), ''),
      trim(regexp_replace(trim(original), '\s*\(\s*\d+\s*\)\s*$', '')))), '\s+', ' ', 'g') END AS key FROM
    (SELECT *, CASE WHEN standard IS NULL AND regexp_matches(original,
        '(?i)^(compound|derivative|deriv|analogue|analog)\s*(no\.?|#|number)?\s*[0-9]+[a-z]?$|^[0-9]{1,3}[a-zA-Z]{0,2}$') THEN 'LOCAL_LABEL'
      WHEN (category='Plant source' AND (regexp_matches(original, '(?i)extract') OR coalesce(descr, '') LIKE '%crude%'))
        OR (regexp_matches(original, '(?i)extract') AND standard IS NULL) THEN 'NATURAL_EXTRACT' ELSE 'PURE_COMPOUND' END AS kind,
      CASE WHEN descr IS NOT NULL THEN trim(split_part(descr, ',', 1)) WHEN original LIKE '% of %'
        THEN trim(regexp_extract(original, '^.*?\s+of\s+(.*)$', 1)) ELSE original END AS species,
      CASE WHEN descr IS NOT NULL THEN trim(substr(descr, instr(descr, ',') + 1)) END AS part,
      CASE WHEN original LIKE 'Ethanol%' THEN 'ethanol' ELSE 'unspecified' END AS solvent FROM names)""", extra=NAMES))
def f8(spark, d):
    t = named_parts(table(spark, d, "part"))
    kind = ids.name_kind(c("original"), c("standard"), c("category"), c("descr"), c("structure"))
    return t.withColumn("kind", kind).select(
        "p_partkey", "kind", ids.compound_key(c("p_partkey"), c("kind"), c("original"), c("standard"), c("descr")).alias("key"))


TITLES = """titles AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Article in Press ' || title WHEN 1 THEN source WHEN 2 THEN upper(lang)
    WHEN 3 THEN 'The ' || lang || ' of all' WHEN 4 THEN title || ' doi:10.1000/1' ELSE title END AS title, upper(source) AS journal,
    'file' || doc_id || '.PDF' AS filename FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM documents))"""


@query("f9_title_validity", sql(r"""SELECT doc_id, trim(t) = '' OR regexp_matches(lower(t),
      'this article has been accepted for publication|undergone full peer review|version of record|all rights reserved|accepted manuscript|author manuscript|article in press|early view|corresponding author|department of|college of')
      OR regexp_matches(t, '(?i)(\bdoi\s*:|https?://doi\.org/|10\.\d{4,9}/|\be-?mail\b|\btel\b|\bfax\b)') OR lower(t)=lower(journal)
      OR length(t) > 250 OR len(string_split(t, ' ')) > 45 OR len(regexp_extract_all(t, '[.!?]')) > 2 AS invalid,
    coalesce(CASE WHEN junk THEN regexp_replace(filename, '(?i)\.pdf$', '') ELSE nullif(trim(title), '') END,
      regexp_replace(filename, '(?i)\.pdf$', '')) AS display FROM
    (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t, length(trim(title)) < 8 OR
      (regexp_matches(title, '\p{L}') AND NOT regexp_matches(title, '\p{Ll}') AND length(trim(title)) < 40)
      OR lower(regexp_extract(trim(title), '^(\S+)', 1)) IN ('of','and','the','for','in','on','with','a','an') AS junk FROM titles)""",
    extra=TITLES))
def f9(spark, d):
    t = table(spark, d, "documents", "doc_id", "source", "lang", "text").withColumn("title", F.substring_index("text", "\n", 1))
    k = c("doc_id") % 6
    title = (F.when(k == 0, F.concat(F.lit("Article in Press "), c("title"))).when(k == 1, c("source")).when(k == 2, F.upper("lang"))
             .when(k == 3, F.concat(F.lit("The "), c("lang"), F.lit(" of all")))
             .when(k == 4, F.concat(c("title"), F.lit(" doi:10.1000/1"))).otherwise(c("title")))
    t = t.select("doc_id", title.alias("title"), F.upper("source").alias("journal"),
                 F.concat(F.lit("file"), c("doc_id").cast("string"), F.lit(".PDF")).alias("filename"))
    return t.select("doc_id", ids.title_is_invalid("title", "journal").alias("invalid"),
                    ids.display_title("title", "filename").alias("display"))


DATES = """dates AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Published ' || strftime(o_orderdate, '%Y-%m-%d') || '.'
    WHEN 1 THEN year(o_orderdate) || '/' || month(o_orderdate) WHEN 2 THEN 'no. 1' || year(o_orderdate) || ' vol ' || year(o_orderdate)
    WHEN 3 THEN 'in press' ELSE repeat('long text without any date ', 3) END AS raw, year(o_orderdate) AS yr FROM orders)"""


@query("f10_year_and_date", sql(r"""SELECT o_orderkey, TRY_CAST(nullif(y, '') AS INT) AS year, coalesce(CASE WHEN y <> '' THEN
      concat_ws('-', y, lpad(nullif(m, ''), 2, '0'), lpad(nullif(dd, ''), 2, '0')) WHEN length(trim(raw)) <= 64 THEN raw END,
      yr::VARCHAR) AS date FROM (SELECT *, regexp_extract(raw, p, 1) AS y, regexp_extract(raw, p, 2) AS m, regexp_extract(raw, p, 3) AS dd
      FROM (SELECT *, '(?:^|[^0-9])((?:18|19|20)\d{2})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?(?:[^0-9]|$)' AS p FROM dates))""", extra=DATES))
def f10(spark, d):
    t = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    k = c("o_orderkey") % 5
    raw = (F.when(k == 0, F.concat(F.lit("Published "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".")))
           .when(k == 1, F.concat_ws("/", y, m)).when(k == 2, F.concat(F.lit("no. 1"), y, F.lit(" vol "), y))
           .when(k == 3, "in press").otherwise("long text without any date " * 3))
    t = t.select("o_orderkey", raw.alias("raw"), F.year("o_orderdate").alias("yr"))
    return t.select("o_orderkey", ids.year_in("raw").alias("year"), ids.partial_date("raw", c("yr")).alias("date"))


@query("f11_title_key", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1) || ' <b>x</b>'),
    '<[^>]+>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def f11(spark, d):
    return docs(spark, d).select(c("document_id").alias("doc_id"),
                                 ids.title_key(F.concat(c("title"), F.lit(" <b>x</b>"))).alias("key"))


@query("f11_title_similarity")
def f11_similarity(spark, d):
    """Matching-block ratio has no SQL form: each title against the title of the next document id."""
    t = docs(spark, d).select("document_id", "title")
    nxt = t.select((c("document_id") - 1).alias("document_id"), c("title").alias("other"))
    return t.join(nxt, "document_id").select(
        "document_id", core.round_half_up(ids.title_similarity("title", "other")).alias("similarity"))


@query("f12_keyword_split", None)
def f12(spark, d):
    """Keywords of the first line with commas read as list marks; checked by hand-written cases."""
    return docs(spark, d).select(
        "document_id", F.array_join(ids.split_keywords(F.replace(c("title"), F.lit(","), F.lit(";"))), "|").alias("keywords"))


@query("f12_keyword_clean", sql(r"""SELECT chunk_id, CASE WHEN k <> '' AND length(k) BETWEEN 2 AND 120 AND l >= 2 AND n <= l
    AND len(string_split_regex(k, '\s+')) <= 14 AND NOT regexp_matches(lower(k),
    'copyright|grant/award|grant award|will notify|volume:|issue:|correspondence|department|university|fax|e-mail|email|telephone|received|accepted|published|doi:|http://|https://')
    THEN k END AS keyword FROM (SELECT *, len(regexp_extract_all(k, '\p{L}')) AS l, len(regexp_extract_all(k, '\p{Nd}')) AS n FROM
    (SELECT chunk_id, trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[ .;,:/\-\t\r\n]+|[ .;,:/\-\t\r\n]+$', '', 'g')) AS k
     FROM chunks))""", "lines", "chunks"))
def f12_clean(spark, d):
    return chunks(spark, d).select("chunk_id", ids.clean_keyword("text").alias("keyword"))


@query("f13_quote_location", sql(r"""SELECT chunk_id, status, CASE WHEN status='OK' THEN p - 1 END AS start_offset,
    CASE WHEN status='OK' THEN p - 1 + length(q) END AS end_offset FROM (SELECT *, CASE WHEN trim(q)='' THEN 'EMPTY_QUOTE' WHEN p=0
    THEN 'NOT_FOUND' WHEN instr(substr(text, p+1), q) > 0 THEN 'AMBIGUOUS' ELSE 'OK' END AS status FROM (SELECT *, instr(text, q) AS p
    FROM (SELECT chunk_id, text, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS q FROM chunks)))""", "lines", "chunks"))
def f13(spark, d):
    q = F.concat_ws(" ", F.split_part(c("text"), F.lit(" "), F.lit(2)), F.split_part(c("text"), F.lit(" "), F.lit(3)))
    loc = ce.locate_quote(c("text"), c("q"))
    return chunks(spark, d).withColumn("q", q).select("chunk_id", loc.alias("loc")).select("chunk_id", "loc.*")


REPORTS = """rep AS (SELECT o_orderkey, 'EC50 was ' || (o_orderkey % 50) || ' mg/L [文献' || (o_orderkey % 7) || ']' ||
    CASE WHEN o_orderkey % 11 = 0 THEN ' [EVIDENCE:x]' WHEN o_orderkey % 13 = 0 THEN ' [见文献三]' ELSE '' END AS txt,
    'value ' || (o_orderkey % 45) || ' MG/L and 7 μg/mL' AS src FROM orders)"""


@query("f15_numeric_traceability", sql(r"""SELECT o_orderkey, NOT contains(replace(lower(src), ' ', ''), (o_orderkey % 50) || 'mg/l')
    AS untraceable, o_orderkey % 11 = 0 OR (o_orderkey % 13 = 0) OR o_orderkey % 7 NOT BETWEEN 1 AND 5 AS illegal FROM rep""",
    extra=REPORTS))
def f15(spark, d):
    k = c("o_orderkey")
    txt = F.concat(F.lit("EC50 was "), (k % 50).cast("string"), F.lit(" mg/L [文献"), (k % 7).cast("string"), F.lit("]"),
                   F.when(k % 11 == 0, " [EVIDENCE:x]").when(k % 13 == 0, " [见文献三]").otherwise(""))
    src = F.concat(F.lit("value "), (k % 45).cast("string"), F.lit(" MG/L and 7 μg/mL"))
    return table(spark, d, "orders", "o_orderkey").select(
        "o_orderkey", ce.numbers_untraceable(txt, src).alias("untraceable"), ce.citations_illegal(txt, F.lit(5)).alias("illegal"))


@query("f16_sentence_split", r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS sentence_no, s AS sentence
    FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, trim(unnest(l)) AS s FROM (SELECT doc_id, string_split(regexp_replace(
    regexp_replace(text, '\s*\n+\s*', '. ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)) WHERE s <> ''""")
def f16(spark, d):
    return docs(spark, d).select(c("document_id").alias("doc_id"), F.posexplode(ce.sentences("text")).alias("p", "sentence")).select(
        "doc_id", (c("p") + 1).alias("sentence_no"), "sentence")


MEAS = """meas AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN ' nd ' WHEN 1 THEN
    '> ' || CAST(l_quantity AS INT) WHEN 2 THEN CAST(l_quantity AS INT) || '.5 AE ' || l_linenumber ELSE CAST(l_quantity AS INT) || ' ± 0.25' END
    AS raw FROM lineitem)"""


@query("f17_measurement_parse", sql(r"""SELECT relation, value, deviation, count(*) AS n, count(DISTINCT raw) AS forms FROM (SELECT raw,
    CASE WHEN upper(trim(raw))='ND' THEN 'ND' WHEN raw LIKE '>%' THEN 'GT' ELSE 'EQ' END AS relation,
    TRY_CAST(regexp_extract_all(raw, '[0-9]+(?:\.[0-9]+)?')[1] AS DOUBLE) AS value,
    TRY_CAST(regexp_extract_all(raw, '[0-9]+(?:\.[0-9]+)?')[2] AS DOUBLE) AS deviation FROM meas) GROUP BY ALL""", extra=MEAS))
def f17(spark, d):
    q = c("l_quantity").cast("int")
    qs = q.cast("string")
    raw = (F.when(q % 4 == 0, " nd ").when(q % 4 == 1, F.concat(F.lit("> "), qs))
           .when(q % 4 == 2, F.concat(qs, F.lit(".5 AE "), c("l_linenumber").cast("string"))).otherwise(F.concat(qs, F.lit(" ± 0.25"))))
    t = table(spark, d, "lineitem", "l_quantity", "l_linenumber").select(raw.alias("raw"), ce.parse_measurement(raw).alias("m"))
    return t.groupBy(c("m.relation").alias("relation"), c("m.value").alias("value"), c("m.deviation").alias("deviation")).agg(
        F.count("*").alias("n"), F.countDistinct("raw").alias("forms"))


@query("f17_bracketed_activity", r"""SELECT unit, relation, CAST(q AS DOUBLE) AS value, count(*) AS n FROM (SELECT 'mg/L' AS unit, CAST(l_quantity AS INT) AS q,
    CASE WHEN l_returnflag='R' THEN 'GT' ELSE 'EQ' END AS relation FROM lineitem) GROUP BY ALL""")
def f17b(spark, d):
    raw = F.concat(F.lit("ic 50 [mg/L]: "), F.when(c("l_returnflag") == "R", "> ").otherwise(""), c("l_quantity").cast("int").cast("string"))
    t = table(spark, d, "lineitem", "l_quantity", "l_returnflag").select(ce.parse_bracketed_activity(raw).alias("m"))
    return t.groupBy("m.unit", "m.relation", "m.value").agg(F.count("*").alias("n"))


@query("f18_page_text_layer", sql(r"""SELECT doc_id, CASE WHEN chars < 1000 OR ur < 0.1 THEN 'SCANNED_NEEDS_OCR' WHEN rr > 0.02 THEN 'TEXT_LAYER_GARBLED'
    WHEN ur >= 0.6 AND chars >= 3000 THEN 'TEXT_LAYER_USABLE' ELSE 'MIXED_OR_LOW_QUALITY' END AS status, chars AS visible_chars FROM
    (SELECT document_id AS doc_id, CAST(sum(v) AS BIGINT) AS chars, avg(CASE WHEN v>=80 AND r::DOUBLE/greatest(v,1)<=0.02 AND s::DOUBLE/greatest(v,1)>=0.45 THEN 1.0 ELSE 0.0 END) AS ur,
     CASE WHEN sum(v)=0 THEN 0 ELSE sum(r)::DOUBLE/sum(v) END AS rr FROM (SELECT document_id, length(regexp_replace(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]', '', 'g')) AS v,
     len(regexp_extract_all(text, '�')) AS r, len(regexp_extract_all(text, '[\p{L}\p{Nd}]')) AS s FROM chunks) GROUP BY document_id)""",
    "lines", "chunks"))
def f18(spark, d):
    return co.page_layer_report(chunks(spark, d)).select(
        c("document_id").alias("doc_id"), "status", "visible_chars")


@query("f20_linear_table_score", sql(r"""SELECT chunk_id, CASE WHEN n >= 4 THEN least(4, n // 2) ELSE 0 END
    + CASE WHEN contains(low, 'inhibition') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(low, '\btable\s+\d+\b') THEN 1 ELSE 0 END
    + CASE WHEN contains(low, 'compound conc') THEN 5 ELSE 0 END AS score,
    CASE WHEN regexp_matches(low || ' ' || lower(section_path), 'table |caption|activity|assay|experimental|method|phytophthora') THEN TRUE ELSE FALSE END AS support FROM
    (SELECT *, lower(text) AS low, len(regexp_extract_all(text, '(?i)\b(?:\d+[a-z]|\d+)\s+(?:\d{1,4}(?:\.\d+)?|\d+\s*u?m)\b')) AS n FROM
     (SELECT chunk_id, section_path, 'Compound conc. inhibition table ' || chunk_index || ' 1a 20 2b 30 ' || chunk_index || ' 50 7c 80 x ' || text AS text FROM chunks))""",
    "lines", "chunks"))
def f20(spark, d):
    n = c("chunk_index").cast("string")
    t = chunks(spark, d).withColumn("text", F.concat(F.lit("Compound conc. inhibition table "), n, F.lit(" 1a 20 2b 30 "), n,
                                                     F.lit(" 50 7c 80 x "), c("text")))
    return t.select("chunk_id", pg.linear_table_score(c("section_path"), c("text")).alias("score"),
                    pg.is_table_support(c("section_path"), c("text")).alias("support"))


@query("f21_subject_type", r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'COMBINATION' WHEN 1 THEN 'COMPOUND_SERIES' WHEN 2 THEN 'FORMULATION' ELSE 'UNKNOWN' END AS type,
    CASE WHEN p_partkey % 4 = 0 THEN p_name || '|' || p_type ELSE '' END AS components, CASE WHEN p_partkey % 3 = 0 THEN 'late blight|phytophthora' ELSE '' END AS targets
    FROM part""")
def f21(spark, d):
    k = c("p_partkey") % 4
    src = F.concat(F.when(k == 0, F.concat(F.lit("Mix comprising "), c("p_name"), F.lit(" and "), c("p_type"), F.lit(" composition")))
                   .when(k == 1, F.concat(F.lit("Formula I "), c("p_name"))).when(k == 2, F.lit("A formulation")).otherwise(c("p_name")),
                   F.when(c("p_partkey") % 3 == 0, "; for Late Blight, Phytophthora and late blight").otherwise(""))
    s = pg.subject(src)
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select(
        "p_partkey", s["type"].alias("type"), F.array_join(s["components"], "|").alias("components"),
        F.array_join(s["targets"], "|").alias("targets"))


@query("f22_table_candidates", sql(r"""SELECT document_id, page_number, source, kind, count(*) AS n FROM (SELECT document_id, page_number, source,
    lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS line_key, min(CASE WHEN regexp_matches(line, '(?i)EC\s*50|IC\s*50|MIC|CTC|fungicidal|activity|inhibition') THEN 'ACTIVITY'
      WHEN regexp_matches(line, '(?i)formulation|composition') THEN 'FORMULATION' WHEN regexp_matches(line, '(?i)formula|structure|synthesis|preparation') THEN 'STRUCTURE' ELSE 'UNKNOWN' END) AS kind
    FROM (SELECT document_id, page_number, line, unnest(['TEXT_CAPTION', 'TEXT_MATRIX']) AS source, unnest([regexp_matches(line, '(?i)^\s*table\s+[\dIVX]+.{0,120}$'),
        regexp_matches(line, '(?i)(EC\s*50|IC\s*50|MIC|CTC).{0,80}(compound|cmpd|treatment|ratio)|(compound|cmpd|treatment|ratio).{0,80}(EC\s*50|IC\s*50|MIC|CTC)')]) AS found
      FROM (SELECT document_id, chunk_index AS page_number, 'Table ' || (chunk_index + 1) || CASE chunk_index % 3 WHEN 0 THEN ' EC50 by treatment ' WHEN 1 THEN ' formulation ' ELSE ' ' END || text AS line FROM chunks
        UNION ALL SELECT document_id, chunk_index, text FROM chunks)) WHERE found GROUP BY ALL) GROUP BY ALL""", "lines", "chunks"))
def f22(spark, d):
    """Every line as it is and once more behind a caption, so that every rule fires somewhere."""
    k = c("chunk_index") % 3
    head = F.concat(F.lit("Table "), (c("chunk_index") + 1).cast("string"), F.when(k == 0, " EC50 by treatment ").when(k == 1, " formulation ").otherwise(" "))
    t = chunks(spark, d).select("document_id", c("chunk_index").alias("page_number"), F.lit(False).alias("activity_page"),
                                F.concat(head, c("text"), F.lit("\n"), c("text")).alias("text"))
    return co.table_candidates(t).groupBy("document_id", "page_number", "source", "kind").agg(F.count("*").alias("n"))


@query("f23_evidence_flags", sql("""SELECT l_returnflag, suspect, inactive, application, count(*) AS n FROM (SELECT l_returnflag,
    l_linenumber % 4 = 1 OR l_linenumber % 4 = 2 AND FALSE AS suspect, l_linenumber % 3 = 0 AS inactive, l_returnflag = 'R' AS application FROM lineitem) GROUP BY ALL"""))
def f23(spark, d):
    k = c("l_linenumber") % 4
    name = F.when(k == 1, "Heat shock protein").when(k == 2, "gene X").otherwise("generic")
    structure = F.when(k == 1, "Enzyme family").when(k == 2, "alkaloid")
    category = F.when(k == 2, "Plant")
    act = F.when(c("l_linenumber") % 3 == 0, "No Inhibition seen").otherwise("EC50 3")
    assay = F.when(c("l_returnflag") == "R", "detached Leaf").otherwise("agar")
    t = table(spark, d, "lineitem", "l_linenumber", "l_returnflag").select(
        "l_returnflag", pg.looks_non_compound(name, structure, category).alias("suspect"), pg.is_inactive(act).alias("inactive"),
        pg.is_application(assay).alias("application"))
    return t.groupBy("l_returnflag", "suspect", "inactive", "application").agg(F.count("*").alias("n"))


@query("f24_markdown_row", r"""SELECT p_partkey, '| ' || concat_ws(' | ', replace(p_name, ' ', '\|'), replace(p_brand, '#', '\\'), p_type || ' x') || ' |' AS line FROM part""")
def f24(spark, d):
    cells = F.array(F.replace(c("p_name"), F.lit(" "), F.lit("|")), F.replace(c("p_brand"), F.lit("#"), F.lit("\\")),
                    F.concat(c("p_type"), F.lit("\nx")))
    return table(spark, d, "part").select("p_partkey", ce.markdown_row(cells).alias("line"))


@query("f25_json_in_text", r"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NO_JSON_OBJECT' END AS error,
    CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def f25(spark, d):
    raw = F.when(c("event_id") % 5 == 0, "no object").otherwise(F.concat(F.lit("Answer:\n"), c("props"), F.lit("\nend")))
    r = ce.read_json_object(raw, "k bigint")
    return table(spark, d, "events", "event_id", "props").select("event_id", r["error"].alias("error"), r["value"]["k"].alias("k"))


@query("f26_keyed_payload", """SELECT p_partkey, p_name AS compound, p_brand AS source, '' AS missing FROM part""")
def f26(spark, d):
    m = ce.keyed_payload(["compound", "source", "missing"], F.array("p_name", "p_brand"))
    return table(spark, d, "part").select("p_partkey", m.alias("m")).select(
        "p_partkey", *[c("m")[k].alias(k) for k in ("compound", "source", "missing")])


@query("f27_formula_guard", """SELECT l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN '''' ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN ' =' ELSE '' END
    || l_linestatus AS cell, count(*) AS n FROM lineitem GROUP BY ALL""")
def f27(spark, d):
    raw = F.concat(F.when(c("l_linenumber") % 2 == 0, " =").otherwise(""), c("l_linestatus"))
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber").select(
        "l_returnflag", ce.guard_formula(raw).alias("cell")).groupBy("l_returnflag", "cell").agg(F.count("*").alias("n"))


@query("f28_author_dedupe", """SELECT c_custkey, c_mktsegment || ' ' || c_custkey || '|' || 'nation' || c_nationkey AS authors FROM customer""")
def f28(spark, d):
    k = c("c_custkey").cast("string")
    a = F.array(F.concat(c("c_mktsegment"), k), F.concat(F.lit("nation"), c("c_nationkey").cast("string")),
                F.concat(c("c_mktsegment"), F.lit(" "), k), F.lit(" "), F.concat(c("c_mktsegment"), F.lit("  "), k))
    return table(spark, d, "customer").select("c_custkey", F.array_join(ids.dedupe_authors(a), "|").alias("authors"))


@query("f29_canonical_digest", """SELECT c_custkey, sha256('{"key":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS digest FROM customer""")
def f29(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", ce.canonical_digest(segment=c("c_mktsegment"), name=c("c_name"), key=c("c_custkey")).alias("digest"))


@query("f30_embedding_text", sql("""SELECT chunk_id, 'Section: ' || section_path || chr(10) || text AS body FROM chunks""", "lines", "chunks"))
def f30(spark, d):
    return chunks(spark, d).select("chunk_id", ce.embedding_text(F.lit(" "), c("section_path"), c("text")).alias("body"))


@query("f31_clamp_round", f"""SELECT l_shipdate::DATE AS day, {r_sql('avg(least(greatest(l_discount*13, 0.0), 1.0))')} AS v FROM lineitem GROUP BY 1""")
def f31(spark, d):
    return table(spark, d, "lineitem", "l_shipdate", "l_discount").groupBy(c("l_shipdate").cast("date").alias("day")).agg(
        core.round_half_up(F.avg(core.clamp(c("l_discount") * 13, 0.0, 1.0))).alias("v"))
