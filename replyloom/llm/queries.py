"""Queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from replyloom.llm import (
    contamination,
    conversations,
    hard_negatives,
    lines,
    mixing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    token_store,
    toxicity,
    urls,
)
from replyloom.llm.common import table
from replyloom.llm.oracle import ORACLE  # noqa: F401


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents"))


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_table(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_table(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_table(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_table(table(spark, sf_dir, "documents"))


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negative_table(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_table(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_quality_model,
        op3_line_dedup,
        op4_contamination,
        op5_url_filter,
        op6_quality_rules,
        op7_mixing,
        op8_sharding,
        op9_suffix_dedup,
        op10_simhash,
        op11_token_store,
        op12_hard_negatives,
        op13_conversation_repair,
    )
}
