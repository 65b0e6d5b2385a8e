"""Queries of the operators over the given tables, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, fingerprints, hamming_index, hard_negatives, language_id, minhash, mixing, ngram_join, packing, pseudonyms, secret_scans, sql_text, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _query(sql: str | None = None):
    def register(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE[query.__name__] = sql
        return query

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


@_query(sql_text.judged_urls(URL_RULES))
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, url_filters.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@_query(sql_text.mixed_rows())
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_weights(_table(spark, sf_dir, "documents"))


@_query()
def op5_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@_query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query()
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


@_query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(sql_text.secrets())
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scans.scan_documents(_table(spark, sf_dir, "documents"))
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda x: x["n"] < len(secret_scans.BASE_RULES))
    return scanned.select("doc_id", *(count(rule.kind) for rule in secret_scans.BASE_RULES), F.sha2(secret_scans.written_spans(base), 256).alias("base_sha256"), secret_scans.written_spans(found).alias("spans"))


@_query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


PSEUDONYM_KEY = b"a key of the test tables"


@_query()
def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """A twentieth each of the rows dropped, emptied, without stops, repeated (`times`) or said by the user; nulls as one space."""
    given = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    harm = (F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn"))) % 20).cast("int")
    rows = turns.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), harm.alias("harm")).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"))


@_query()
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair_conversations(damaged_turns(turns), times=F.col("times"))
    digests = conversation_repair.text_digests(repaired.pieces)
    every, told, digest = turns.select("conv_id").distinct().alias("every"), repaired.reports.alias("told"), digests.alias("digest")
    out = every.join(told, F.col("every.conv_id").eqNullSafe(F.col("told.conv_id")), "left")
    out = out.join(digest, F.col("every.conv_id").eqNullSafe(F.col("digest.conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("every.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@_query(sql_text.hard_negatives())
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


@_query()
def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))
