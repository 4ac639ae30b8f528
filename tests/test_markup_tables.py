"""Tables of marked-up papers: spans, nesting, headers, footnotes, broken markup."""

import pytest
from pyspark.sql import functions as F

from litquarry.sources import markup_tables as mt

HEAD = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text>'


def one(spark, body):
    df = spark.createDataFrame([(1, HEAD + body + "</text></TEI>", "x")], "paper long, markup string, rows string")
    return mt.with_headers(mt.parse_tables(df, "paper", "markup")).collect()


@pytest.mark.parametrize("rows, headers, data", [
    ("<row><cell>A</cell><cell cols='2'>B</cell></row><row><cell>1</cell><cell>2.5</cell><cell>3 %</cell></row>", ["A", "B", "B"], [["1", "2.5", "3 %"]]),
    ("<row><cell>A</cell></row><row><cell>n.d.</cell><cell>x</cell></row>", ["A", "A"], [["n.d.", "x"]]),
    ("<row><cell>1</cell><cell>2</cell></row><row><cell>3</cell></row>", ["1", "2"], [["3", ""]]),
    ("<row><cell>A</cell><cell>A</cell></row><row><cell/><cell> mg  L </cell></row><row><cell cols='0'>&#160;5 - 7</cell><cell cols='zz'>b</cell></row>", ["A", "A — mg L"], [["5 - 7", "b"]]),
    ("<row/><row><cell>12 kg</cell></row><row><cell>&lt; 4,5</cell></row>", ["12 kg"], [["< 4,5"]]),
    ("", [], []),
])
def test_headers_and_data(spark, rows, headers, data):
    r = one(spark, f"<table>{rows}</table>")[0]
    assert (r.table_ref, r.headers, r.data, r.status) == ("T1", headers, data, "DONE")


def test_figures_first_then_tables_outside_them(spark):
    body = ("<table><row><cell>out</cell></row></table><figure type='TABLE' ><head>H </head><figDesc>D\n d</figDesc><label>2</label><table><row><cell>in<table><row><cell>nested</cell></row></table></cell></row></table>"
            "<note>plain  note</note></figure><figure type='picture'><table><row><cell>pic</cell></row></table></figure><figure type='table'><note><s>a</s><s/><s>b</s></note></figure>")
    got = [(r.table_ref, r.label, r.caption, r.headers, r.footnotes) for r in one(spark, body)]
    assert got == [("T1", "2", "H D d", ["innested"], ["plain note"]), ("T2", None, None, [], ["a", "b"]), ("T3", None, None, ["out"], []),
                   ("T4", None, None, ["nested"], []), ("T5", None, None, ["pic"], [])]


def test_counts_of_broken_and_empty_papers(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, HEAD), (4, HEAD + "</text></TEI>"), (None, "<table/>"), (5, "<x><table/><table/></x>")], "paper long, markup string")
    tables = mt.parse_tables(df, "paper", "markup")
    assert tuple(mt.backfill_counts(tables, "paper").first()) == (6, 3, 3, 3)
    assert mt.data_cells(mt.with_headers(tables), "paper").count() == 0
    assert tuple(mt.backfill_counts(mt.parse_tables(df.limit(0), "paper", "markup"), "paper").first()) == (0, 0, 0, 0)


def test_papers_of_one_partition_are_read_by_all_tasks(spark):
    papers = spark.createDataFrame([(i, f"<TEI><table><row><cell>{i}</cell></row></table></TEI>") for i in range(400)], "paper long, markup string").coalesce(1)
    held = mt.parse_tables(papers, "paper", "markup").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in held) == 400
