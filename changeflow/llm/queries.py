"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, language_id, lexical_search, line_dedup, minhash_dedup, packing, passage_dedup, prefix_trie, quality, secret_scan, subword,
    token_counts, vector_dedup,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": _over("documents", line_dedup.op1_line_dedup),
    "op2_secret_scan": _over("documents", secret_scan.op2_secret_scan),
    "op3_language_id": _over("documents", language_id.op3_language_id),
    "op4_best_fit_packing": _over("documents", packing.op4_best_fit_packing),
    "op5_minhash_dedup": _over("documents", minhash_dedup.op5_minhash_dedup),
    "op6_passage_dedup": _over("documents", passage_dedup.op6_passage_dedup),
    "op7_quality_rules": _over("documents", quality.op7_quality_rules),
    "op8_vector_dedup": _over("embeddings", vector_dedup.op8_vector_dedup),
    "op9_token_counts": _over("documents", token_counts.op9_token_counts),
    "op10_sentencepiece": _over("documents", subword.op10_sentencepiece),
    "op11_decontaminate": decontaminate.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_lexical_search": lexical_search.query,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_secret_scan": secret_scan.SQL,
    "op5_minhash_dedup": minhash_dedup.SQL,
    "op7_quality_rules": quality.SQL,
    "op11_decontaminate": decontaminate.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
