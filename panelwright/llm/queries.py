"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format, decontamination, license_scan, line_dedup, lm_scoring, merkle_manifest, minhash_dedup, quality_classifier, quality_rules,
    simhash_dedup, source_mixing, url_filter, vector_codes,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": decontamination.op1,
        "op2_line_dedup": lambda s, d: line_dedup.op2(table(s, d, "documents")),
        "op3_lm_scoring": lambda s, d: lm_scoring.op3(table(s, d, "documents")),
        "op4_url_filter": url_filter.op4,
        "op5_chat_format": chat_format.op5,
        "op6_license_scan": lambda s, d: license_scan.op6(table(s, d, "documents")),
        "op7_simhash_near_dedup": lambda s, d: simhash_dedup.op7(table(s, d, "documents")),
        "op8_quality_rules": lambda s, d: quality_rules.op8(table(s, d, "documents")),
        "op9_source_mixing": lambda s, d: source_mixing.op9(table(s, d, "documents")),
        "op10_quality_classifier": quality_classifier.op10,
        "op11_minhash_near_dedup": lambda s, d: minhash_dedup.op11(table(s, d, "documents")),
        "op12_merkle_manifest": lambda s, d: merkle_manifest.op12(table(s, d, "documents")),
        "op13_vector_codes": lambda s, d: vector_codes.op13(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": url_filter.op4_sql(), "op5_chat_format": chat_format.op5_sql(), "op8_quality_rules": quality_rules.op8_sql(),
        "op11_minhash_near_dedup": lambda s, d: minhash_dedup.op11(table(s, d, "documents")),
        "op11_minhash_near_dedup": minhash_dedup.op11_sql(), "op12_merkle_manifest": merkle_manifest.op12_sql(), "op13_vector_codes": vector_codes.op13_sql(),
    }
