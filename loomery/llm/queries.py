"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import decontaminate, fill_in_middle, jaccard_join, language_id, lm_scoring, mixing, oracles, pii, quality, spelling, substring_dedup, suffix_dedup, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_token_files": token_files.query,
        "op3_lm_scoring": lm_scoring.query,
        "op4_mixing": mixing.query,
        "op5_quality": quality.query,
        "op6_pii": pii.query,
        "op7_language_id": language_id.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_warc": warc.query,
        "op11_suffix_dedup": suffix_dedup.query,
        "op12_spelling": spelling.query,
        "op13_fill_in_middle": fill_in_middle.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": oracles.leaks(),
        "op4_mixing": oracles.MIXING,
        "op8_jaccard_join": oracles.JACCARD,
        "op9_substring_dedup": oracles.SUBSTRINGS,
        "op10_warc": oracles.WARC,
        "op11_suffix_dedup": oracles.SUFFIXES,
        "op12_spelling": oracles.SPELLING,
        "op13_fill_in_middle": oracles.MIDDLES,
    }
