"""Query expansion whole: translated forms, and as many queries as the reference takes."""

import __spark_entry__ as entry
from check_oracles import compare, connect
from litquarry.operators import expansion as ex

FOLDER = "/root/testdata/sf0.001"


def agrees(spark, name):
    ok, n, _, _, message = compare(spark, connect(FOLDER), FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
    assert n > 0


def test_translated_queries_end_the_expansion(spark):
    q = spark.createDataFrame([(1, "why does blight spread"), (2, "no term here")], "experiment_id long, query string")
    sub = spark.createDataFrame([(1, 0, "blight of leaves")], "experiment_id long, query_no int, query string")
    vocab = spark.createDataFrame([("blight", "late blight", "PROCESS")], "alias string, canonical string, category string")
    related = spark.createDataFrame([], "canonical string, term string")
    got = [(r.experiment_id, r.query) for r in ex.vocabulary_expansion(q, sub, vocab, related).orderBy("experiment_id", "query_no").collect()]
    assert got == [(1, "why does blight spread"), (1, "blight of leaves"), (1, "late blight"), (1, "why does blight spread late blight"),
                   (1, "blight of leaves late blight"), (1, "late blight late blight"), (2, "no term here")]


def test_whole_expansion_agrees_with_its_sql(spark):
    agrees(spark, "r12_expansion_with_translated")


def test_union_of_queries_goes_past_the_fifth(spark):
    agrees(spark, "u5_linked_query_union_36")
    assert entry.queries()["u5_linked_query_union_36"](spark, FOLDER).where("query_no >= 5").count()
