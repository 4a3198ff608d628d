"""Operators for preparing training text, each with its registered query."""

from importlib import import_module

from ._registry import ORACLES, QUERIES, Query

_QUERY_MODULES = ("op1_vector_files", "op2_ngram_join", "op3_quality", "op4_backoff", "op5_chat", "op6_decontaminate", "op7_pseudonyms", "op8_warc", "op9_language", "op10_mixing", "op11_phrases", "op12_toxicity", "op13_ns_clusters")


def queries() -> dict[str, Query]:
    for module in _QUERY_MODULES:
        import_module(f"{__name__}.{module}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
