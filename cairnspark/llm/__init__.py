"""Training-data operators. Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module that holds it.
_QUERIES = {
    "op8_suffix_dedup": "suffix_dedup",
    "op3_ngram_jaccard": "ngram_jaccard",
    "op2_quote_linking": "quote_linking",
    "op5_pivot_topk": "pivot_topk",
    "op1_html_extraction": "html_extraction",
    "op6_toxicity": "toxicity",
    "op7_quality_rff": "quality_classifier",
    "op4_bpe_automaton": "bpe_automaton",
    "op9_secret_scan": "secret_scan",
    "op10_decontamination": "decontamination",
    "op11_license_scan": "license_scan",
    "op12_fill_in_middle": "fill_in_middle",
    "op13_sequenced_changes": "sequenced_changes",
}


#: Queries that SQL can express.
_WITH_SQL = {"op2_quote_linking", "op3_ngram_jaccard", "op5_pivot_topk", "op8_suffix_dedup", "op9_secret_scan", "op10_decontamination", "op11_license_scan", "op12_fill_in_middle"}


def _module(query: str):
    return import_module(f"{__name__}.{_QUERIES[query]}")


def _lazily(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(_module(name), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """A query's module is imported when it runs: one that can't be imported takes no other along."""
    return {name: _lazily(name) for name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).ORACLE_SQL for name in _QUERIES if name in _WITH_SQL}
