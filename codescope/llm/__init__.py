"""Operators for training-data pipelines. Nothing outside this package imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprint, hard_negatives, html_text, jaccard_join, metric_join, packing, quality, spelling, suffix_dedup, token_output, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_document_fingerprints": fingerprint.op1_document_fingerprints,
        "op2_token_output": token_output.op2_token_output,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_html_extraction": html_text.op8_html_extraction,
        "op9_quality_classifier": quality.op9_quality_classifier,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_embedding_near_dedup": metric_join.op12_embedding_near_dedup,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_formatting": chat.ORACLE, "op10_jaccard_join": jaccard_join.ORACLE, "op12_embedding_near_dedup": metric_join.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
