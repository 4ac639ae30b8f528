"""Registered queries against their oracle SQL on the smallest tables.

A spread over all families runs by default; LITQUARRY_ALL_ORACLES=1 runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
SPREAD = [
    "r1_index_statistics", "r3_bm25_multi_field", "r4_text_match_all_terms", "r6_dense_top_k", "r15_ir_metrics_bm25", "f1_doi_normalise", "f7_cell_similarity",
    "f8_name_kind_and_key", "f9_title_validity", "f13_quote_location", "f16_sentence_split", "f21_subject_type", "d1_canonical_dedup", "d2_corpus_prepare",
    "d5_screening_decision", "a22_cohort_hash", "s11_upsert", "a14_classification_merge", "d7_classification_validation", "d8_row_validation", "d9_versioned_replace",
    "d10_coverage_audit", "j8_similar_rows", "d16_row_matching", "j9_routing_confusion", "w1_priority_chunks", "w9_fixed_count_windows", "w10_static_batches",
    "a3_facet_counts", "a4_compound_rollup", "a21_potency_median", "r19_fielded_score_rank", "j7_dictionary_substring", "j7_dictionary_whole_words", "d12_review_merge",
    "d14_graph_neighbourhood", "r12_expansion_with_translated", "r13_entity_enhanced_queries", "c1_cosine_pairs", "j13_nearest_cross_document_pairs", "t11_cluster_representatives",
    "a26_topic_terms", "s2_corpus_excluded", "s7_markdown_tables", "s9_table_headers", "d17_page_triage", "d23_review_merge", "a25_review_rates", "x3_usage_windows",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("LITQUARRY_ALL_ORACLES") else SPREAD


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    ok, n, _, _, message = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
    assert n > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_entry(spark):
    df = entry.entry(spark)
    assert "ndcg" in df.columns
    assert df.limit(1).count() == 1
