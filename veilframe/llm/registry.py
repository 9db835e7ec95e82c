"""The queries of the numbered operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, maxent, merkle, neardup, negatives, pieces, pii, quality, shards, substrings, urls
from .scratch import small_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_documents(spark, sf_dir))


def op1_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.digest(_documents(spark, sf_dir))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(_documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_maxent_score": op1_maxent_score,
        "op2_histogram_shards": op2_histogram_shards,
        "op3_bpe_chunks": op3_bpe_chunks,
        "op4_decontaminate": op4_decontaminate,
        "op5_pii_spans": op5_pii_spans,
        "op6_url_filter": op6_url_filter,
        "op7_quality_votes": op7_quality_votes,
        "op8_ngram_join": op8_ngram_join,
        "op9_language_id": op9_language_id,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_pieces": op13_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": decontaminate.SQL, "op12_hard_negatives": negatives.SQL}
