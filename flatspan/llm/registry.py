"""The queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from flatspan.llm import alignment, archives, decontamination, embeddings, language, language_model, lexical, mixing, sharding, simhash, substrings, toxicity, urls
from flatspan.llm.common import ensure_checkpoint_dir, read_table
from flatspan.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(read_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_and_store(read_table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid4().hex}")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model, patterns = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(patterns, model)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("item")


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.archived_pages(read_table(spark, sf_dir, "pages"), f"{ensure_checkpoint_dir(spark)}/archives-{uuid4().hex}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Query]:
    found = [
        op1_substring_dedup, op2_source_mixing, op3_embedding_near_dedup, op4_simhash_near_dedup, op5_benchmark_decontamination,
        op6_sharding, op7_language_id, op8_url_filters, op9_lm_scoring, op10_toxicity,
        op11_token_alignment, op12_lexical_search, op13_warc_archives,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
