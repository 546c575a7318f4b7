"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arrow_sequences, feistel_sharding, html_extract, lz_fingerprint, mixing, packing, quality_crf, robust_outliers, secret_scan, simhash
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2048, 0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.apply_rules(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op8_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_sequences.encode_to_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, width=1, radius=4))


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = [op1_best_fit_packing, op2_html_extraction, op3_quality_crf, op4_soft_mixing, op5_robust_outliers, op6_secret_scan, op7_feistel_sharding, op8_arrow_sequences, op9_simhash_near_dedup, op10_lz_fingerprint]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    """None of the ten can be put in SQL whole: they need tokenizers, HTML parsing, trained models, iterated estimates,
    decoding, a checksum that SQL lacks, XXH64, or phrase dictionaries. tests/llm holds each against brute force."""
    return {}
