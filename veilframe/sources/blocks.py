"""Labelled text blocks: files whose blocks are parted by --- and carry # key: value lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sample_hash

META = r"^#\s*([^:]+):\s*(.+)$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def input_hash(spark: SparkSession, path: str) -> str:
    """One hash of all files: of their fingerprints in order, which are a line a file."""
    prints = fingerprint(spark, path).agg(F.md5(F.array_join(F.array_sort(F.collect_list("md5")), "")).alias("md5"))
    return prints.first()["md5"]


def _meta(lines: Column, key: str) -> Column:
    found = F.filter(lines, lambda x: F.lower(F.trim(F.regexp_extract(x, META, 1))) == key)
    last = F.get(found, F.size(found) - 1)
    return F.trim(F.regexp_extract(last, META, 2))


def parse_strict(df: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """(keep, block, name, expected_critical, text): blocks end at lines that are --- alone. Lines
    shaped as metadata go, other # lines stay; a name is the text's first 40 characters if it has
    none. Blocks without text go."""
    blocks = df.select(*keep, F.posexplode(F.split(value, r"(?m)^---$")).alias("block", "body"))
    lines = F.split("body", "\n")
    blocks = blocks.withColumn("_lines", lines).withColumn("text", F.trim(F.regexp_replace(F.array_join(F.filter("_lines", lambda x: ~F.rlike(x, F.lit(META))), "\n"), r"^\s+|\s+$", "")))
    short = F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.col("text"))
    name, critical = _meta(F.col("_lines"), "name"), _meta(F.col("_lines"), "expected_critical")
    out = blocks.select(*keep, "block", F.coalesce(F.nullif(name, F.lit("")), short).alias("name"), F.coalesce(F.lower(critical).isin("1", "true", "yes"), F.lit(False)).alias("expected_critical"), "text")
    return out.where("text <> ''")


def parse_loose(df: DataFrame, value: str = "value", file: str = "file", max_samples: int | None = None) -> DataFrame:
    """As parse_strict, but blocks end at any ---, all # lines go, only true and false are known,
    and a block without name is Sample_n by its place among those kept of its file."""
    blocks = df.select(file, F.posexplode(F.split(value, "---")).alias("block", "body"))
    text = F.trim(F.regexp_replace(F.array_join(F.filter(F.split("body", "\n"), lambda x: ~F.rlike(x, F.lit(r"^\s*#"))), "\n"), r"^\s+|\s+$", ""))
    named = F.trim(F.regexp_extract("body", r"(?i)#\s*name:[ \t]*([^\n]*)", 1))
    critical = F.lower(F.regexp_extract("body", r"(?i)expected_critical:\s*(true|false)", 1)) == "true"
    kept = blocks.select(file, "block", named.alias("_name"), critical.alias("expected_critical"), text.alias("text")).where("text <> ''")
    kept = kept.withColumn("_n", F.row_number().over(W.partitionBy(file).orderBy("block")))
    out = kept.select(file, "block", "_n", F.coalesce(F.nullif("_name", F.lit("")), F.concat(F.lit("Sample_"), F.col("_n").cast("string"))).alias("name"), "expected_critical", "text")
    return (out.where(F.col("_n") <= max_samples) if max_samples else out).drop("_n")


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_hash", sample_hash(F.col("name"), F.col("text"), F.col("expected_critical")))
