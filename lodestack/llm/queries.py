"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ctw, decontam, langid, licenses, packing, quality, simhash, span_dedup, sql, suffix_dedup, token_counts
from .common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.deduplicate(read(spark, sf_dir, "documents")).select("doc_id", "n_removed", "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("matches")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("failed_rules")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read(spark, sf_dir, "documents")).drop("removed", "kept")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read(spark, sf_dir, "documents"))


def queries() -> dict:
    all_of_them = (
        op1_token_counts,
        op2_substring_dedup,
        op3_license_scan,
        op4_simhash_near_dedup,
        op5_benchmark_decontamination,
        op6_quality_rules,
        op7_packing,
        op8_language_id,
        op9_suffix_dedup,
        op10_lm_scoring,
    )
    return {f.__name__: f for f in all_of_them}


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express; the others are tested against brute force in tests/llm."""
    return {"op6_quality_rules": sql.quality(), "op7_packing": sql.packing()}
