"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import op01_near_dedup, op02_packing, op03_suffix_dedup, op04_substring_dedup, op05_mixing, op06_topk, op07_quality, op08_token_output, op09_line_dedup, op10_exact_dedup, op11_language_id, op12_prefix_trie, op13_alignment


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op01_near_dedup.op1_near_dedup,
        "op2_packing": op02_packing.op2_packing,
        "op3_suffix_dedup": op03_suffix_dedup.op3_suffix_dedup,
        "op4_substring_dedup": op04_substring_dedup.op4_substring_dedup,
        "op5_mixing": op05_mixing.op5_mixing,
        "op6_topk_search": op06_topk.op6_topk_search,
        "op7_quality_classifier": op07_quality.op7_quality_classifier,
        "op8_token_output": op08_token_output.op8_token_output,
        "op9_line_dedup": op09_line_dedup.op9_line_dedup,
        "op10_exact_dedup": op10_exact_dedup.op10_exact_dedup,
        "op11_language_id": op11_language_id.op11_language_id,
        "op12_prefix_trie": op12_prefix_trie.op12_prefix_trie,
        "op13_cross_tokenizer_alignment": op13_alignment.op13_cross_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": op04_substring_dedup.ORACLE, "op5_mixing": op05_mixing.oracle(), "op6_topk_search": op06_topk.ORACLE, "op9_line_dedup": op09_line_dedup.ORACLE, "op10_exact_dedup": op10_exact_dedup.ORACLE, "op12_prefix_trie": op12_prefix_trie.ORACLE}
