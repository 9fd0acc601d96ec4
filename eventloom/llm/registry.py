"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact_dedup, jaccard_join, language_id, line_dedup, media, mixing, packing, pii, quality, substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_pii": pii.query,
        "op3_mix_sources": mixing.query,
        "op4_quality": quality.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_best_fit_packing": packing.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_media_columns": media.query,
        "op10_language_id": language_id.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op3_mix_sources": mixing.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op6_jaccard_join": jaccard_join.ORACLE,
    }
