"""Registered queries: every operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskmart.llm import alignment, bpe, chat, decontamination, fingerprints, jaccard, lattice, pages, quality, resampling, sharding, suffixes, toxicity


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda s, d: decontamination.op1_decontamination(_read(s, d, "documents"), _read(s, d, "benchmark")),
        "op2_jaccard": lambda s, d: jaccard.op2_jaccard(_read(s, d, "documents")),
        "op3_lm_score": lambda s, d: lattice.op3_lm_score(_read(s, d, "documents")),
        "op4_toxicity": lambda s, d: toxicity.op4_toxicity(_read(s, d, "documents"), _read(s, d, "labels")),
        "op5_main_text": lambda s, d: pages.op5_main_text(_read(s, d, "pages")),
        "op6_fingerprints": lambda s, d: fingerprints.op6_fingerprints(_read(s, d, "documents")),
        "op7_quality": lambda s, d: quality.op7_quality(_read(s, d, "documents"), _read(s, d, "labels")),
        "op8_bpe": lambda s, d: bpe.op8_bpe(_read(s, d, "documents")),
        "op9_suffix_dedup": lambda s, d: suffixes.op9_suffix_dedup(_read(s, d, "documents")),
        "op10_sharding": lambda s, d: sharding.op10_sharding(_read(s, d, "documents")),
        "op11_chat": lambda s, d: chat.op11_chat(_read(s, d, "conversations")),
        "op12_resampling": lambda s, d: resampling.op12_resampling(_read(s, d, "documents"), _read(s, d, "benchmark")),
        "op13_alignment": lambda s, d: alignment.op13_alignment(_read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.SQL, "op2_jaccard": jaccard.SQL, "op11_chat": chat.SQL, "op12_resampling": resampling.SQL}
