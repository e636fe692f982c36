"""Queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from buyerscope.llm import (
    conversation_trie, embeddings, language_id, license_scan, line_dedup, packing, quality, resampling, sentencepiece, sharding, simhash,
    token_files, url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        sentencepiece.op1_sentencepiece_viterbi, embeddings.op2_projection_forest, url_filter.op3_temporal_url_filter,
        token_files.op4_repair_token_files, packing.op5_best_fit_packing, language_id.op6_kneser_ney_language,
        line_dedup.op7_line_spread, simhash.op8_simhash_gray_index, sharding.op9_jump_shards, quality.op10_line_first_quality,
        conversation_trie.op11_conversation_trie, license_scan.op12_license_automaton, resampling.op13_importance_resampling,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_temporal_url_filter": url_filter.ORACLE_SQL,
        "op7_line_spread": line_dedup.ORACLE_SQL,
        "op10_line_first_quality": quality.ORACLE_SQL,
        "op11_conversation_trie": conversation_trie.ORACLE_SQL,
        "op13_importance_resampling": resampling.ORACLE_SQL,
    }
