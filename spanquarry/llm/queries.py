"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from spanquarry.llm import decontaminate, fingerprints, language_id, licenses, lm_score, mixing, near_dedup, sharding, substring_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked, _ = near_dedup.link(_table(spark, sf_dir, "documents"), "doc_id", "text", width=3, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    return decontaminate.contained(_table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k.json", 1024)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), "doc_id", "text", 16)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def queries() -> dict:
    found = {f.__name__: f for f in (op1_license_scan, op2_near_dedup, op3_fingerprints, op4_decontamination, op5_token_counts, op6_lm_score, op7_sharding, op8_substring_dedup, op9_mixing, op10_language_id)}
    found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict:
    return {"op1_license_scan": licenses.scan_sql(), "op2_near_dedup": near_dedup.link_sql(), "op4_decontamination": decontaminate.contained_sql(), "op8_substring_dedup": substring_dedup.remove_repeats_sql(), "op9_mixing": mixing.mix_sql()}
