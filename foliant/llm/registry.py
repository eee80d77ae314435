"""The queries of this package and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import digests, jaccard, language, mixing, packing, quality, repeats, repetition, sharding, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_sequences": tokens.op1_token_sequences,
        "op2_fingerprints": digests.op2_fingerprints,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_repetition_coverage": repetition.op4_repetition_coverage,
        "op5_jaccard_join": jaccard.op5_jaccard_join,
        "op6_extendible_shards": sharding.op6_extendible_shards,
        "op7_repeated_passages": repeats.op7_repeated_passages,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_source_mix": mixing.op9_source_mix,
        "op10_page_language": language.op10_page_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_repetition_coverage": repetition.SQL,
        "op5_jaccard_join": jaccard.SQL,
        "op6_extendible_shards": sharding.SQL,
        "op7_repeated_passages": repeats.SQL,
        "op9_source_mix": mixing.SQL,
    }
