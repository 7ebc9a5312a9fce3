"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, hostrules, packing, pq, rollup, secretscan, simhash, simple8b, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.pack_documents(_table(spark, sf_dir, "documents"))


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op10_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.verdicts(_table(spark, sf_dir, "documents"))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.maintained(_table(spark, sf_dir, "documents"))


def op2_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.groups(_table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pq_near_dedup": op2_pq_near_dedup,
    "op3_simple8b": op3_simple8b,
    "op4_host_quality": op4_host_quality,
    "op5_warc": op5_warc,
    "op6_pattern_packing": op6_pattern_packing,
    "op7_secret_randomness": op7_secret_randomness,
    "op8_simhash_bktree": op8_simhash_bktree,
    "op9_token_rollup": op9_token_rollup,
    "op10_toxicity_kneser_ney": op10_toxicity_kneser_ney,
}
ORACLE_SQL: dict[str, str] = {
    "op4_host_quality": hostrules.sql(),
    "op5_warc": "select page_id, url, html from pages where html is not null",
}
