"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, language_id, multiset_fingerprint, packing, quality_classifier, repetition_rules, sentencepiece_stream, sharding, simhash_dedup, token_counts
from .common import documents


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.groups(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_fingerprint.equal_documents(documents(spark, sf_dir))


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules.repetition(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_stream.encode_documents(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_brown_lm,
        op2_token_counts,
        op3_quality_classifier,
        op4_simhash_dedup,
        op5_packing,
        op6_multiset_fingerprint,
        op7_repetition_rules,
        op8_sentencepiece,
        op9_sharding,
        op10_language_id,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_multiset_fingerprint": multiset_fingerprint.ORACLE_SQL,
    "op9_sharding": sharding.oracle_sql(),
}
