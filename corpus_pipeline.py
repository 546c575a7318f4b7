"""A training corpus from raw documents: quality, near duplicates, secrets, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import mixing, packing, quality_crf, secret_scan, simhash
from foliant.llm.common import table, written
from foliant.llm.queries import tokenizer_path

#: Shares of the words of the mix; its words over those that enter the stage; how often a domain or document may be
#: repeated; and the clean posterior from which on a document is never left out.
MIX_TARGETS, MIX_BUDGET, MIX_MOST, MIX_CLEAN = {"clean": 0.985, "junk": 0.01, "toxic": 0.005}, 1.1, 1.1, 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    return quality_crf.keep_good(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs, words=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, are replaced by a mark; n_chars follows."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at the rates that bring each domain nearest its share; clean ones all stay."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), MIX_TARGETS, MIX_BUDGET, MIX_MOST, most_bad=1.0, bounds=mixing.Bounds(MIX_CLEAN, MIX_MOST))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a sequence of 2048 ids."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]
#: Trained models, fingerprints and token ids are not SQL; tests/llm/test_pipeline.py has the stages' brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
