"""Queries ``opN_<name>`` and the SQL that they are compared with, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, dedup, jaccard, lengths, linear, pack, secrets, topk, urls

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), urls.RULES)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.length_histogram(table(spark, sf_dir, "documents"), tokenizer_path()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": op1_top_k,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_bpe": op3_bpe,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_secrets": op6_secrets,
        "op7_quality": op7_quality,
        "op8_jaccard": op8_jaccard,
        "op9_url_filter": op9_url_filter,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": topk.SQL,
        "op2_exact_dedup": dedup.SQL,
        "op6_secrets": secrets.SQL,
        "op8_jaccard": jaccard.SQL,
        "op9_url_filter": urls.SQL,
    }
