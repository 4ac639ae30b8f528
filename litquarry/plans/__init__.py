"""Queries composed from the operators."""

from importlib import import_module

MODULES = ["retrieval_queries", "function_queries", "corpus_queries", "evidence_queries", "window_queries",
           "report_queries", "entity_queries", "cluster_queries",
           "document_queries", "ingest_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
