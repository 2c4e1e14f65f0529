"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, quality_classifier, sentencepiece_codec, sharding, substring_dedup, suffix_dedup


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_sharding": sharding.op2_sharding,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_language_id": language_id.op9_language_id,
        "op10_quality": quality_classifier.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op6_jaccard_join": jaccard_join.OP6_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
    }
