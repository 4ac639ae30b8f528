"""Reading corpora, chunks, gold labels, manifests, files, Markdown tables and markup."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from litquarry.functions.cells import row_fingerprint
from litquarry.functions.core import first_non_blank, nz, seeded_order
from litquarry.functions.identifiers import doi_normalise
from litquarry.scale import spread

CHUNK_DDL = ("document_id string, canonical_key string, doi string, chunk_id string, chunk_index int, content_type string, section_path string, "
             "paragraph_index int, sentence_start int, sentence_end int, title string, text string, source_pdf string, source_tei string, "
             "chunk_strategy_version string")
CORPUS_DDL = "document_id string, documentId string, id string, title string, abstract string, abstractText string, doi string, doi_normalized string, year int, duplicate_of string"
GOLD_DDL = "document_id string, question_id string, classification string, rows array<struct<cells:array<string>,anchors:array<struct<chunk_id:string,exact_quote:string>>>>"


# ---- JSON lines ----------------------------------------------------------------------------------

def json_lines(lines: DataFrame, ddl: str) -> DataFrame:
    """Parse ``value`` lines; a line that is no valid object has null ``row`` and a reason."""
    body = F.regexp_replace("value", "^﻿", "")
    kept = lines.withColumn("value", body).where(nz("value").isNotNull() & ~F.startswith(F.ltrim("value"), F.lit("#")))
    schema = T.StructType.fromDDL(ddl).add("_corrupt", T.StringType())
    parsed = kept.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.rlike("value", F.lit(r"^\s*\{"))
    return parsed.withColumn("reason", F.when(bad, "MALFORMED_JSON"))


def parse_chunks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk rows, and skipped lines with the reason."""
    j = json_lines(lines, CHUNK_DDL)
    reason = F.coalesce("reason", F.when(nz("row.chunk_id").isNull() | nz("row.document_id").isNull(), F.lit("MISSING_ID")))
    j = j.withColumn("reason", reason)
    return j.where("reason IS NULL").select("row.*").drop("_corrupt"), j.where("reason IS NOT NULL").select("value", "reason")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_chunks(spark.read.text(path))


def parse_corpus(lines: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records under canonical field names, and excluded rows with status.

    ``ids(document_id)`` restricts the corpus; ids without a record are excluded as MISSING_DOCUMENT.
    """
    j = json_lines(lines, CORPUS_DDL)
    r = j.select(
        first_non_blank("row.document_id", "row.documentId", "row.id").alias("document_id"), F.coalesce("row.title", F.lit("")).alias("title"),
        F.coalesce("row.abstract", "row.abstractText", F.lit("")).alias("abstract"), doi_normalise(F.coalesce("row.doi", "row.doi_normalized")).alias("doi"),
        F.col("row.year").alias("year"), F.col("row.duplicate_of").alias("duplicate_of"), "reason")
    r = r.withColumn("status", F.when(F.col("reason").isNotNull() | F.col("document_id").isNull(), "INPUT_INVALID")).drop("reason")
    if ids is None:
        return r.where("status IS NULL").drop("status"), r.where("status IS NOT NULL").select("document_id", "status")
    wanted = ids.select("document_id").distinct()
    good = r.where("status IS NULL")
    outside = good.join(wanted, "document_id", "left_anti").select("document_id", F.lit("OUTSIDE_ID_LIST").alias("status"))
    missing = wanted.join(good, "document_id", "left_anti").select("document_id", F.lit("MISSING_DOCUMENT").alias("status"))
    excluded = r.where("status IS NOT NULL").select("document_id", "status").unionByName(outside).unionByName(missing)
    return good.join(wanted, "document_id", "left_semi").drop("status"), excluded


def read_corpus(spark: SparkSession, path: str, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_corpus(spark.read.text(path), ids)


def parse_gold(lines: DataFrame) -> DataFrame:
    """Gold label records; blank lines and comment lines are skipped."""
    return json_lines(lines, GOLD_DDL).where("reason IS NULL").select("row.*").drop("_corrupt")


# ---- files ---------------------------------------------------------------------------------------

def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, length and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_files(rows: DataFrame, folder: str, key: str, text: str) -> None:
    """A file ``key=value/part-0.txt`` for each key below ``folder``: its texts, each with a line feed behind.

    Tasks write their files and put them in place by a rename, so that a task run twice leaves the same files and the driver
    has none to commit. The folder is one that every executor shares and that ``pyarrow.fs`` reaches.
    """
    placed = spread(rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")), "key").sortWithinPartitions("key")
    root = folder if ":" in folder else f"file://{folder}"
    root = re.sub("^file:/+", "file:///", root)
    shared, top = fs.FileSystem.from_uri(root)
    shared.create_dir(top)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        n, last, out = 0, None, None
        own = uuid.uuid4().hex

        def done():
            out.close()
            store.move(f"{last}/.{own}", f"{last}/part-0.txt")

        for batch in batches:
            for value, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = f"{top}/{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else quote(value, safe='')}"
                if at != last:
                    if out is not None:
                        done()
                    store.create_dir(at)
                    out, last, n = store.open_output_stream(f"{at}/.{own}"), at, n + 1
                if body.is_valid:
                    out.write(body.as_buffer())
                out.write(b"\n")
        if out is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    placed.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_manifest(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with quoted multi-line fields; a byte-order mark on the first header is removed."""
    df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).csv(path))
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def select_candidates(rows: DataFrame, key: str, category: str | None = None, wanted: list[str] | None = None, allow: DataFrame | None = None,
                      order: Column | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Category filter, whitelist, repeatable order and limit over manifest rows."""
    out = rows if not wanted else rows.where(F.lower(F.trim(category)).isin([w.lower() for w in wanted]))
    if allow is not None:
        out = out.join(allow.select(key).distinct(), key, "left_semi")
    return out if limit is None else out.orderBy(order if order is not None else seeded_order(key, seed), key).limit(limit)


# ---- Markdown tables -----------------------------------------------------------------------------

ESCAPED = "\u0001"


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.replace(F.trim(line), F.lit("\\|"), F.lit(ESCAPED)), r"^\|", ""), r"\|\s*$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: F.replace(F.replace(F.trim(c), F.lit(ESCAPED), F.lit("|")), F.lit("\\\\"), F.lit("\\")))


def parse_markdown_tables(files: DataFrame, headers: list[str], scope: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each file's evidence table, and files whose table breaks the contract.

    ``files(path, value)``. The first table row must be the headers and the second a separator. Short rows
    are padded, long rows dropped, blank rows skipped and repeated rows kept once.
    """
    n = len(headers)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.startswith(F.trim(x), F.lit("|")))
    t = files.select("path", lines.alias("l"))
    first, second = _cells(F.get("l", F.lit(0))), _cells(F.get("l", F.lit(1)))
    reason = (F.when(F.size("l") < 2, "NO_TABLE").when(first != F.array(*[F.lit(h) for h in headers]), "HEADER_MISMATCH")
              .when(~F.forall(second, lambda c: F.rlike(c, F.lit(r"^:?-{3,}:?$"))), "MISSING_SEPARATOR"))
    t = t.withColumn("reason", reason)
    rows = t.where("reason IS NULL").select("path", F.posexplode(F.slice("l", 3, 1_000_000_000)).alias("row_index", "line")).withColumn("cells", _cells(F.col("line")))
    rows = rows.where((F.size("cells") <= n) & F.exists("cells", lambda c: c != ""))
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), n)), 1, n)
    rows = rows.withColumn("cells", padded).withColumn("fingerprint", row_fingerprint(F.lit(scope), F.col("cells")))
    once = rows.groupBy("path", "fingerprint").agg(F.min_by(F.struct("row_index", "cells"), "row_index").alias("r"))
    return once.select("path", "fingerprint", "r.*"), t.where("reason IS NOT NULL").select("path", "reason")


# ---- markup --------------------------------------------------------------------------------------

SKIP_TAGS = {"script", "style", "nav", "footer", "header", "noscript", "aside"}
SKIP_SECTION = re.compile(r"(?i)^(references?|bibliography|acknowledg\w*|funding|author contributions?|supplementary.*|conflicts? of interest)$")
UNIT_SCHEMA = "page_id long, ord long, content_type string, section_path string, paragraph int, sentence int, text string"


class _Units(HTMLParser):
    """Collects (content type, section path, paragraph text) while walking the nesting of heads."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.heads: list[tuple[int, str]] = []
        self.out: list[tuple[str, str, str]] = []
        self.skip = 0
        self.kind = None
        self.buf: list[str] = []

    def _flush(self):
        text = re.sub(r"\s+", " ", "".join(self.buf)).strip()
        self.buf = []
        if not text or self.kind is None:
            return
        if self.kind.startswith("h"):
            level = int(self.kind[1])
            self.heads = [h for h in self.heads if h[0] < level] + [(level, text)]
        elif not any(SKIP_SECTION.match(h[1]) for h in self.heads):
            kind = {"figcaption": "caption", "caption": "caption", "title": "title"}.get(self.kind, "body")
            self.out.append((kind, " > ".join(h[1] for h in self.heads), text))

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self._flush()
            self.skip, self.kind = self.skip + 1, None
        elif tag in ("p", "li", "figcaption", "caption", "title") or re.fullmatch(r"h[1-6]", tag):
            self._flush()
            self.kind = tag

    def handle_endtag(self, tag):
        if tag in SKIP_TAGS:
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "li", "figcaption", "caption", "title") or re.fullmatch(r"h[1-6]", tag):
            self._flush()
            self.kind = None

    def handle_data(self, data):
        if not self.skip and self.kind:
            self.buf.append(data)


def extract_units(pages: DataFrame) -> DataFrame:
    """Sentences of titles, paragraphs and captions with the path of headings above them: ``pages(page_id, html)``."""
    def run(batches):
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                p = _Units()
                p.feed(html or "")
                p._flush()
                n = 0
                for i, (kind, path, text) in enumerate(p.out):
                    for j, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+", text) if x):
                        rows.append((page, n, kind, path, i, j, s))
                        n += 1
            yield pd.DataFrame(rows, columns=["page_id", "ord", "content_type", "section_path", "paragraph", "sentence", "text"])

    return pages.select("page_id", "html").mapInPandas(run, UNIT_SCHEMA)


def header_fields(pages: DataFrame) -> DataFrame:
    """Title, language and paragraph count without building a tree."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return pages.select("page_id", F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"),
                        F.regexp_count("html", F.lit(r"(?i)<p>")).alias("paragraphs"))


def assemble_tables(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header text per column and data cells of tables given as ``cells(table_id, row_no, col_no, span, text)``.

    Spanning cells fill their columns, leading rows without any number are header rows, blank header
    cells take the text to their left, and stacked headers are joined. Windows run over one table row or
    one table column.
    """
    number = r"^[<>≤≥~±\s]*[-+]?\d"
    wide = cells.select("table_id", "row_no", F.explode(F.sequence(F.col("col_no"), F.col("col_no") + F.greatest(F.coalesce("span", F.lit(1)), F.lit(1)) - 1)).alias("col_no"),
                        nz("text").alias("text"))
    has_number = wide.groupBy("table_id", "row_no").agg(F.max(F.coalesce(F.rlike("text", F.lit(number)), F.lit(False))).alias("_num"))
    first_data = has_number.where("_num").groupBy("table_id").agg(F.min("row_no").alias("_first"))
    j = wide.join(first_data, "table_id", "left")
    is_head = F.col("_first").isNull() & (F.col("row_no") == 0) | (F.col("row_no") < F.greatest(F.col("_first"), F.lit(1)))
    row = W.partitionBy("table_id", "row_no").orderBy("col_no").rowsBetween(W.unboundedPreceding, 0)
    head = j.where(is_head).withColumn("text", F.last("text", ignorenulls=True).over(row)).where("text IS NOT NULL")
    stacked = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"])), " — ")
    headers = head.groupBy("table_id", "col_no").agg(stacked.alias("header"))  # a few header rows each
    data = j.where(~is_head).select("table_id", "row_no", "col_no", "text")
    return headers, data


# ---- sinks ---------------------------------------------------------------------------------------

CELL_LIMIT = 32_767


def clip_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cut text to what a spreadsheet cell can hold."""
    return df.withColumns({c: F.substring(c, 1, CELL_LIMIT) for c in columns})


def write_run(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> str:
    """Write one run's rows to a folder of their own; Spark commits a folder only when all tasks are done."""
    target = f"{path}/run_id={run_id}"
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(target)
    else:
        writer.format(fmt).save(target)
    return target


def write_markdown(df: DataFrame, path: str, headers: list[str]) -> None:
    """Markdown table rows as text files, header and separator in front of each part file's rows."""
    from litquarry.functions.cells import markdown_row
    cells = F.array(*[F.coalesce(F.col(h).cast("string"), F.lit("")) for h in headers])
    df.select(markdown_row(cells).alias("value")).write.mode("overwrite").text(path)
