"""Registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import check_sql, conversations, exact_dedup, jaccard_join, language, mixing, pieces, quality, resampling, sharding, suffix_dedup, token_store, trigrams, warc
from attesta.llm.common import documents, tokenizer_file
from attesta.llm.registry import query


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


@query("op3_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_sizes(documents(spark, sf_dir))


@query("op5_exact_dedup", sql="""
WITH keyed AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
        AS text_sha256 FROM documents),
grouped AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM keyed JOIN grouped USING (text_sha256)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(documents(spark, sf_dir))


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_and_checked(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


@query("op9_token_store")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


@query("op7_katz_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigrams.score(documents(spark, sf_dir))


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(documents(spark, sf_dir))


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(documents(spark, sf_dir))


@query("op6_warc_derivatives")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op13_conversation_repair", sql=check_sql.REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op12_importance_resampling", sql=check_sql.RESAMPLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(documents(spark, sf_dir))
