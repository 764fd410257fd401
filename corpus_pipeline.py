"""Corpus preparation in five stages, each over everything its predecessor kept.

quality classifier -> near copies (5-word shingles) -> benchmark decontamination -> mixing to
target weights -> sharding.  A stage takes (spark, docs, sf_dir); all but the last return
rows with the columns of ``documents``.  The last adds the place of each row: size, text_crc32,
law, shard, slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edictum.llm import decontaminate, mixing, nearcopies, quality, sharding
from edictum.llm.common import kept_after, scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (Jaccard of 0.8 and more) the document of least doc_id stays."""
    return nearcopies.first_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also re-parameterised, go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat as often as the mix takes them, shard by shard of the splitting tree."""
    return mixing.mixed_documents(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there, and keeps its text."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_first),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", place_in_shards),
]

#: The classifier and the components can't be put in SQL; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again,
    and its intermediate tables are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = kept_after(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
