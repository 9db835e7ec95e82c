"""The corpus pipeline: language ID, near duplicates, decontamination, PII masking, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. `run` writes each stage's result as Parquet and reads it again as the next
one's docs, so a lost executor costs one stage at most and no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, decontaminate, langid, neardup, pii
from veilframe.llm.scratch import new_path, small_batches


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the models reject: no letters, or text like no language."""
    small_batches(spark)
    return langid.keep_known(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near copies."""
    small_batches(spark)
    return neardup.keep_one(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the text and counts its characters anew; every document stays."""
    small_batches(spark)
    columns = docs.columns
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(columns)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text."""
    small_batches(spark)
    return bpe.encode(docs)


STAGES = [
    ("language", _language),
    ("near-duplicates", _near_duplicates),
    ("benchmark", _benchmark),
    ("pii", _pii),
    ("bpe", _encode),
]

#: Language models and BPE are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
