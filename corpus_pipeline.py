"""The corpus pipeline: language, near-duplicates, contamination, mixing and sharding, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flatspan.llm import decontamination, language, mixing, sharding, simhash
from flatspan.llm.common import read_table
from flatspan.runtime import ship_package, stored_for_now


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found."""
    ship_package(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    ship_package(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    ship_package(spark)
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place."""
    return sharding.shard_documents(docs).drop("virtual")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: XXH64, trained profiles and spaced seeds are beyond DuckDB's SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet to the shared folder, read by the next one and deleted."""
    docs, drop = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        done, drop_done = stored_for_now(stage(spark, docs, sf_dir))
        if drop:
            drop()  # what this stage read
        docs, drop = done, drop_done
    return docs
