"""Result tables: JSON scans and sinks, runs that resume, and a cache that expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import DIRECT_TYPES

VERSION = "2.0"

# The fields of a result row in order, with their types, and the column or expression of an
# assessed row that each comes from. Stages run for all rows at once, so a row has no time of its own.
RESULT_FIELDS = """
sample_name string name
sample_hash string sample_hash
original_text string text
expected_critical boolean expected_critical
e_score double e_score
e_score_entity_count bigint e_score_entity_count
e_score_entity_types array<string> e_types
e_score_max_weight double e_max_weight
e_score_mean_confidence double e_mean_confidence
e_score_median_confidence double e_median_confidence
e_score_masked_text string e_masked
q_score double q_score
q_score_expected_k double expected_k
q_score_qi_count bigint q_score_qi_count
q_score_qi_types array<string> qis.qi_type
q_score_mean_confidence double q_mean_confidence
q_score_median_confidence double q_median_confidence
q_score_has_rare_disease boolean rare_disease
q_score_has_rare_occupation boolean rare_occupation
q_score_masked_text string q_masked
c_score_risk_level string c_level
c_score_risk_score double c_score
c_score_factors_detected array<string> detected
c_score_factor_count bigint size(detected)
c_score_deemed_sensitive boolean deemed_sensitive
text_length bigint text_length
word_count bigint word_count
sentence_count bigint sentence_count
masked_text_length bigint masked_text_length
mask_token_count bigint mask_token_count
mask_ratio double mask_ratio
chars_masked_ratio double chars_masked_ratio
remaining_word_count bigint remaining_word_count
total_entity_count bigint total_entity_count
unique_entity_type_count bigint unique_entity_type_count
entity_density double entity_density
has_person boolean has_person
has_location boolean has_location
has_datetime boolean has_datetime
has_organization boolean has_organization
has_direct_identifier boolean has_direct_identifier
narrative_entity_count bigint narrative_entity_count
direct_identifier_count bigint direct_identifier_count
has_high_risk_combo boolean has_high_risk_combo
high_risk_combo_count bigint high_risk_combo_count
entity_type_combo_signature string entity_type_combo_signature
e_q_score_sum double e_q_score_sum
e_q_score_product double e_q_score_product
e_q_score_max double e_q_score_max
score_disparity double score_disparity
e_score_coverage double e_score_coverage
q_score_coverage double q_score_coverage
combined_mean_confidence double combined_mean_confidence
combined_median_confidence double combined_median_confidence
e_score_time double NULL
q_score_time double NULL
c_score_time double NULL
processed_at string date_format(current_timestamp(),"yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
c_score_original_risk_score double c_original
c_score_original_deemed_sensitive boolean original_sensitive
c_scores_by_k map<string,double> c_scores_by_k
masked_counts_by_k map<string,bigint> masked_counts_by_k
"""
_FIELDS = [line.split(" ") for line in RESULT_FIELDS.strip().split("\n")]
RESULT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind, _ in _FIELDS)


def result_rows(assessed: DataFrame) -> DataFrame:
    """The result rows of assessed samples (name, sample_hash, text, expected_critical)."""
    return assessed.selectExpr(*(f"CAST({of} AS {kind}) AS {name}" for name, kind, of in _FIELDS))


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Rows of JSON arrays or objects, a document a file, or of a row a line, as `write_json` has it."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A row a line, so that large files can be read in parts."""
    df.write.mode("overwrite").json(path)


def classification(results: DataFrame) -> DataFrame:
    """The policy's input from result rows: renamed, defaults for what is missing, and a direct
    identifier if the flag says so or a type is one."""
    have = set(results.columns)
    get = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    none = F.array().cast("array<string>")
    direct = F.arrays_overlap(get("e_score_entity_types", none), F.array(*map(F.lit, DIRECT_TYPES)))
    return results.select(
        get("sample_hash", F.lit("")).alias("sample_hash"), get("expected_critical", F.lit(False)).alias("expected_critical"),
        get("e_score", F.lit(0.0)).alias("e_score"), get("q_score", F.lit(0.0)).alias("q_score"), get("c_score_risk_score", F.lit(0.0)).alias("c_score"),
        (direct | get("has_direct_identifier", F.lit(False))).alias("has_direct"), get("has_high_risk_combo", F.lit(False)).alias("has_combo"),
        get("q_score_has_rare_disease", F.lit(False)).alias("rare_disease"), get("q_score_has_rare_occupation", F.lit(False)).alias("rare_occupation"),
        get("c_score_factors_detected", none).alias("factors"), get("e_score_masked_text", F.lit("")).alias("e_masked"), get("q_score_masked_text", F.lit("")).alias("q_masked"),
    )


def write_suite(judged: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """The test suite's sink: rows that were judged with a detection for each factor, which has no
    place in the text, and rows without a reply with an error and no detections."""
    suite(judged, name, text).write.mode("overwrite").json(path)


def suite(judged: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    none = F.lit(None)
    detection = lambda f: F.struct(f["name"].alias("type"), f["detected"].alias("detected"), f["confidence"].alias("confidence"), f["explanation"].alias("explanation"), none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("string").alias("text"))
    failed = F.col("c_status") == "no reply"
    told = F.transform("factors", detection)
    return judged.select(
        F.col(name).alias("name"), F.col(text).alias("text"), F.when(~failed, F.col("c_level")).alias("overall_risk"), F.when(~failed, F.col("c_score")).alias("risk_score"),
        F.when(failed, F.col("c_status")).alias("error"), F.when(failed, F.slice(told, 1, 0)).otherwise(told).alias("detections"),
    )


def save_run(results: DataFrame, path: str, input_hash: str, threshold: float, now: Column | None = None, version: str = VERSION) -> None:
    """Appends rows to the run's table. Runs are folders of it, by input, threshold and version, so
    a run with other ones neither reads nor overwrites them, and those of before stay as backups.
    Rows that are appended twice are there twice: `commits` keeps a table whose batches may be replayed."""
    keyed = results.withColumns({"input_file_hash": F.lit(input_hash), "c_score_threshold": F.lit(float(threshold)), "version": F.lit(version), "last_updated": F.current_timestamp() if now is None else now})
    keyed.write.mode("append").partitionBy("version", "input_file_hash", "c_score_threshold").parquet(path)


def load_run(spark: SparkSession, path: str, input_hash: str, threshold: float, version: str = VERSION) -> DataFrame:
    """Rows of the run with the same input, threshold and version; the partitions of others aren't read."""
    found = spark.read.parquet(path).schema
    keys = {"version": "string", "input_file_hash": "string", "c_score_threshold": "double"}  # not as inferred: a hash may be all digits
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if keys[f.name] == "double" else T.StringType()) if f.name in keys else f for f in found])
    return of_run(spark.read.schema(schema).parquet(path), input_hash, threshold, version)


def clear_run(spark: SparkSession, path: str, input_hash: str, threshold: float, stamp: str, version: str = VERSION) -> None:
    """Moves a run's rows to <path>.<stamp>.backup, so that the next run starts afresh."""
    folder = f"version={version}/input_file_hash={input_hash}/c_score_threshold={float(threshold)}"
    jvm = spark._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}/{folder}", f"{path}.{stamp}.backup/{folder}"))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(old):
        files.mkdirs(new.getParent())
        files.rename(old, new)


def of_run(results: DataFrame, input_hash: str, threshold: float, version: str = VERSION) -> DataFrame:
    """Rows of a run with the same input, threshold and version: others don't count as done."""
    return results.where((F.col("input_file_hash") == input_hash) & (F.col("c_score_threshold") == float(threshold)) & (F.col("version") == version))


def todo(samples: DataFrame, done: DataFrame, key: str = "sample_hash") -> DataFrame:
    """Samples that aren't done."""
    return samples.join(done.select(key), key, "left_anti")


def reused(samples: DataFrame, done: DataFrame, key: str = "sample_hash") -> DataFrame:
    return done.join(samples.select(key), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "sample_hash", at: str = "processed_at") -> DataFrame:
    """One row a key: of equal keys the latest, new rows before old ones. An aggregate, combined
    before the shuffle, so a key with many rows is no hot task."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_of(both, key, ["_new", at]).select(old.columns)


def latest_of(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """One row a key, the largest by these columns."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(key, "r.*").select(rows.columns)


def alive(cache: DataFrame, now: Column, seconds: int = 86_400) -> DataFrame:
    """Entries (cache_key, ts, payload) that haven't expired; a null payload is a known absence."""
    return cache.where(F.col("ts") > now - F.make_interval(secs=F.lit(seconds)))


def cached(keys: DataFrame, cache: DataFrame, now: Column, key: str = "cache_key") -> DataFrame:
    """Adds payload and hit: whether the key has a live entry, payload or not."""
    live = alive(cache, now).groupBy(key).agg(F.max_by("payload", "ts").alias("payload"), F.lit(True).alias("hit"))
    return keys.join(live, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
