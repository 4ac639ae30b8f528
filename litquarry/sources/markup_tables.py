"""Tables of marked-up papers: markup to rows of cells, header rows, captions, footnotes and backfill counts."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from litquarry.scale import spread

# Fixed value: a cell that holds a measurement rather than a label, blanks taken out.
DATA_VALUE = r"^[<>~≈=]?\s*\d[\d.,]*\s*(?:[-–±/]\s*\d[\d.,]*)?\s*%?$"
HEADER_JOIN = " — "
DONE, FAILED = "DONE", "FAILED"


def _name(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _text(element: ET.Element | None) -> str | None:
    if element is None:
        return None
    return re.sub(r"\s+", " ", "".join(element.itertext()).replace("\xa0", " ")).strip() or None


def _inside(element: ET.Element, name: str) -> ET.Element | None:
    return next((e for e in element.iter() if e is not element and _name(e) == name), None)


def _child(element: ET.Element, name: str) -> ET.Element | None:
    return next((e for e in element if _name(e) == name), None)


def _span(cell: ET.Element) -> int:
    value = (cell.get("cols") or "").strip()
    return max(1, int(value)) if re.fullmatch(r"[+-]?[0-9]{1,4}", value) else 1


def _rows(table: ET.Element | None) -> list[list[str]]:
    """Cell texts; a cell over several columns is followed by empty ones. Rows of nested tables belong to those."""
    out = []
    for row in (e for e in (table if table is not None else ()) if _name(e) == "row"):
        cells: list[str] = []
        for cell in (e for e in row if _name(e) == "cell"):
            cells += [_text(cell) or ""] + [""] * (_span(cell) - 1)
        if cells:
            out.append(cells)
    return out


def _footnotes(figure: ET.Element) -> list[str]:
    note = _inside(figure, "note")
    if note is None:
        return []
    sentences = [e for e in note.iter() if _name(e) == "s"]
    return [t for t in map(_text, sentences or [note]) if t]


def tables_of(markup: str) -> list[tuple]:
    """(label, caption, rows, footnotes) of the table figures of one paper, then of the tables outside of them."""
    root = ET.fromstring(markup)
    found, taken = [], set()
    for figure in root.iter():
        if _name(figure) == "figure" and "table" in (figure.get("type") or "").lower():
            table, head, described = _inside(figure, "table"), _text(_child(figure, "head")), _text(_inside(figure, "figDesc"))
            taken.add(id(table))
            found.append((_text(_child(figure, "label")), " ".join(t for t in (head, described) if t) or None, _rows(table), _footnotes(figure)))
    return found + [(None, None, _rows(t), []) for t in root.iter() if _name(t) == "table" and id(t) not in taken]


def parse_tables(papers: DataFrame, key: str, markup: str) -> DataFrame:
    """One row per table: key, table_ref, label, caption, rows, footnotes, status; rows are arrays of cell texts.

    A paper without a table has one row without table_ref; so has one whose markup cannot be read, with status FAILED, as
    has a paper without markup. Every paper is read on its own, so what a task holds is bounded by one batch.
    """
    schema = T.StructType([papers.schema[key]] + T.StructType.fromDDL(
        "table_ref string, label string, caption string, rows array<array<string>>, footnotes array<string>, status string").fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for paper, text in zip(pdf[key].array, pdf[markup]):
                try:
                    found = tables_of(text if isinstance(text, str) else "")
                except ET.ParseError:
                    out.append((paper, None, None, None, None, None, FAILED))
                    continue
                out += [(paper, f"T{i}", *t, DONE) for i, t in enumerate(found, 1)] or [(paper, None, None, None, None, None, DONE)]
            yield pd.DataFrame(out, columns=schema.names)

    # small files come as one partition, and reading a paper costs far more than its bytes
    return spread(papers.select(key, markup), F.xxhash64(key, markup)).mapInPandas(run, schema)


def _padded(rows: Column) -> Column:
    width = F.aggregate(rows, F.lit(0), lambda most, r: F.greatest(most, F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def _filled(row: Column) -> Column:
    """Every blank cell takes the text to its left."""
    return F.transform(row, lambda _, i: F.coalesce(F.get(F.reverse(F.filter(F.slice(row, F.lit(1), i + 1), lambda x: F.trim(x) != "")), F.lit(0)), F.lit("")))


def with_headers(tables: DataFrame) -> DataFrame:
    """Tables with ``headers`` and ``data``: leading rows without a measurement are merged to one header per column.

    There is at least one header row, and where no row holds a measurement it is the first. Stacked headers are
    joined, repeats left out. Everything happens inside the row of a table.
    """
    measured = lambda r: F.exists(r, lambda x: F.replace(x, F.lit(" "), F.lit("")).rlike(DATA_VALUE))
    t = tables.withColumn("rows", _padded(F.coalesce("rows", F.array().cast("array<array<string>>"))))
    first = F.array_position(F.transform("rows", measured), True) - 1
    t = t.withColumn("_n", F.least(F.greatest(first, F.lit(1)), F.size("rows")).cast("int"))
    t = t.withColumn("_head", F.transform(F.slice("rows", F.lit(1), F.col("_n")), _filled))
    column = lambda i: F.array_distinct(F.filter(F.transform("_head", lambda r: F.trim(F.get(r, i))), lambda x: x != ""))
    headers = F.transform(F.coalesce(F.get("_head", F.lit(0)), F.array().cast("array<string>")), lambda _, i: F.array_join(column(i), HEADER_JOIN))
    return t.withColumn("headers", headers).withColumn("data", F.slice("rows", F.col("_n") + 1, F.size("rows") + 1)).drop("_n", "_head", "rows")


def data_cells(tables: DataFrame, key: str) -> DataFrame:
    """(key, table_ref, row_no, col_no, header, text) of the data rows of ``with_headers``."""
    rows = tables.where("table_ref IS NOT NULL").select(key, "table_ref", "headers", F.posexplode("data").alias("row_no", "_r"))
    return rows.select(key, "table_ref", "row_no", "headers", F.posexplode("_r").alias("col_no", "text")).select(
        key, "table_ref", "row_no", "col_no", F.get("headers", F.col("col_no")).alias("header"), "text")


def backfill_counts(tables: DataFrame, key: str) -> DataFrame:
    """Papers scanned, done and failed, and the tables found."""
    papers = tables.groupBy(key).agg(F.min("status").alias("status"), F.count("table_ref").alias("tables"))
    return papers.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("status") == DONE).alias("done"), F.count_if(F.col("status") == FAILED).alias("failed"),
                      F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"))
