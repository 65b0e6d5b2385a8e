"""From raw documents to packed training sequences.

Every stage works on all rows that the one before kept: documents without a language go, one document of each group of
near duplicates stays, secrets are masked, sources are mixed to their target weights, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lucidframe.llm import language_id, mixing, ngram_join, packing, secret_scans
from lucidframe.llm.store import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_per_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scans.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("ngram_join", deduplicate), ("secret_scans", mask_secrets), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None  # n-gram links, language models and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
