"""The subpackage's registered queries (spark, sf_dir) -> DataFrame and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, html_extract, line_dedup, minhash_dedup, packing, secret_scan, suffix_dedup, token_counts, toxicity
from .shared import load


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(load(spark, sf_dir, "pages"))


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.prefix_token_counts(load(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(load(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(load(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(load(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_prefix_token_counts": op3_prefix_token_counts,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {}
