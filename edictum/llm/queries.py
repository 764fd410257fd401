"""The ten operators as driver queries, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edictum.llm import chat, decontaminate, lines, mixing, quality, rules, sharding, simhash, substring, suffix
from edictum.llm.common import table


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(table(spark, sf_dir, "conversations"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key", "source", "lang")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix": op1_suffix,
    "op2_chat": op2_chat,
    "op3_lines": op3_lines,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_rules": op6_rules,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring": op9_substring,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op1_suffix": suffix.ORACLE,
    "op2_chat": chat.ORACLE,
    "op3_lines": lines.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_substring": substring.ORACLE,
}
