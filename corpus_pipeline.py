"""A corpus in five stages, each on all that the one before it kept: quality rules, language, near-duplicates, mixing,
packing. ``ORACLE_SQL`` is None: the isolation forest, the language model and the tokenizer are beyond SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelry.llm import language_id, mixing, near_dedup, packing, quality_forest
from voxelry.llm.queries import TOKENIZER
from voxelry.llm.shared import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_forest.kept_rows(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_rules", quality_rules), ("language_id", language), ("near_dedup", near_duplicates), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
