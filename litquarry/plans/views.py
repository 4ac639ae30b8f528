"""How the shared test tables stand in for papers, chunks, judgments and evidence.

Every view exists twice, as a DataFrame and as a SQL common table expression, so that a
query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from litquarry.functions.core import nz
from litquarry.sources.tables import table

TOK_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def tok(col: str) -> str:
    return TOK_SQL.format(col)


def r_sql(expr: str, digits: int = 4) -> str:
    return f"floor(({expr})*1e{digits}+0.5)/1e{digits}"


def ratio_sql(num: str, den: str, digits: int = 4) -> str:
    return f"CASE WHEN ({den})>0 THEN {r_sql(f'(({num})::DOUBLE)/({den})', digits)} ELSE 0.0 END"


SECTIONS = ["Abstract", "Introduction", "Methods > Assay", "Results > Activity", "Discussion", "Other"]
_SECTION_SQL = "CASE (pos % 6) " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SECTIONS)) + " END"

CTE = {
    "docs": r"""docs AS (SELECT doc_id AS document_id, split_part(text, chr(10), 1) AS title, source AS section, text
        FROM documents)""",
    "lines": r"""lines0 AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
        unnest(string_split(text, chr(10))) AS line FROM documents)""",
    "chunks": rf"""chunks AS (SELECT doc_id AS document_id, CAST(pos AS INT) AS chunk_index,
        doc_id || ':' || pos AS chunk_id, {_SECTION_SQL} AS section_path, line AS text
        FROM lines0 WHERE trim(line) <> '')""",
    "questions": r"""questions AS (SELECT item_id AS experiment_id, 0 AS query_no, text AS query FROM benchmark)""",
    "sub": r"""sub AS (SELECT item_id AS experiment_id,
        CAST(generate_subscripts(string_split_regex(text, '\.\s+'), 1) AS INT) AS query_no,
        unnest(string_split_regex(text, '\.\s+')) AS query FROM benchmark)""",
    "labelled": r"""labelled AS (SELECT doc_id AS document_id, CASE WHEN toxic=1 THEN 'DISTRACTOR'
        WHEN quality=1 THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS label FROM labels)""",
    "evidence": r"""evidence AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
            CAST(round(l_extendedprice*100) AS BIGINT)) AS evidence_id,
        l_orderkey AS document_id, l_partkey AS part_id, p_name AS compound_name, p_type AS structure_type,
        p_brand AS source_category, s_name AS organism, l_returnflag AS assay_method,
        'EC50 ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' mg/L' AS activity_data,
        CASE WHEN l_linestatus='F' THEN 'APPROVED' ELSE 'PENDING' END AS review_status,
        CASE WHEN l_quantity >= 2 THEN 'VALID' ELSE 'INVALID' END AS validation_status,
        l_linenumber <> 7 AS is_current, l_discount*10 AS model_confidence, l_shipdate AS updated_at,
        CASE WHEN l_tax >= 0.04 THEN 'membrane target' ELSE ' ' END AS mechanism,
        CASE WHEN l_tax >= 0.06 THEN 'field application' END AS application,
        CASE WHEN p_size % 3 = 0 THEN 'EXTRACT' WHEN p_size % 3 = 1 THEN 'PURE' ELSE 'LOCAL' END AS name_kind
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)""",
    "reportable": r"""reportable AS (SELECT * FROM evidence WHERE is_current AND validation_status='VALID'
        AND review_status IN ('PENDING','APPROVED'))""",
}


def sql(body: str, *names: str, extra: str = "") -> str:
    """SQL with the named view expressions in front; ``extra`` adds more of them."""
    ctes = [CTE[n] for n in names] + ([extra] if extra else [])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "source", "text").select(
        F.col("doc_id").alias("document_id"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("section"), "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One chunk per non-blank line; the section label only gives rankings something to rank."""
    lines = table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    section = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), (F.col("pos") % 6 + 1).cast("int"))
    return lines.select(
        F.col("doc_id").alias("document_id"), F.col("pos").alias("chunk_index"),
        F.concat_ws(":", "doc_id", "pos").alias("chunk_id"), section.alias("section_path"), F.col("line").alias("text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("experiment_id"), F.lit(0).alias("query_no"), F.col("text").alias("query"))


def sub_queries(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each question, numbered from 1."""
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("experiment_id"), F.posexplode(F.split("text", r"\.\s+")).alias("p", "query")).select(
        "experiment_id", (F.col("p") + 1).alias("query_no"), "query")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Judgment label per document; a clash of flags counts as distractor."""
    label = F.when(F.col("toxic") == 1, "DISTRACTOR").when(F.col("quality") == 1, "RELEVANT").otherwise("IRRELEVANT")
    return table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), label.alias("label"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
               "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    supp = table(spark, d, "supplier", "s_suppkey", "s_name")
    c = F.col
    size3 = c("p_size") % 3
    return (
        li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey).select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                        F.round(c("l_extendedprice") * 100).cast("long")).alias("evidence_id"),
            c("l_orderkey").alias("document_id"), c("l_partkey").alias("part_id"), c("p_name").alias("compound_name"),
            c("p_type").alias("structure_type"), c("p_brand").alias("source_category"), c("s_name").alias("organism"),
            c("l_returnflag").alias("assay_method"),
            F.concat(F.lit("EC50 "), c("l_quantity").cast("int").cast("string"), F.lit(" mg/L")).alias("activity_data"),
            F.when(c("l_linestatus") == "F", "APPROVED").otherwise("PENDING").alias("review_status"),
            F.when(c("l_quantity") >= 2, "VALID").otherwise("INVALID").alias("validation_status"),
            (c("l_linenumber") != 7).alias("is_current"), (c("l_discount") * 10).alias("model_confidence"),
            c("l_shipdate").alias("updated_at"),
            F.when(c("l_tax") >= 0.04, "membrane target").otherwise(" ").alias("mechanism"),
            F.when(c("l_tax") >= 0.06, "field application").alias("application"),
            F.when(size3 == 0, "EXTRACT").when(size3 == 1, "PURE").otherwise("LOCAL").alias("name_kind"),
        )
    )


def reportable(spark: SparkSession, d: str) -> DataFrame:
    from litquarry.operators.report import reportable as keep
    return keep(evidence(spark, d))
