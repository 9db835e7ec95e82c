"""Queries on runs: batches that are replayed, a client whose memo outlives the run, streams whose
state expires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import client, commits, results
from ..sources.shared import new_path
from ..streaming import resume, state
from .explicit_queries import read


def commit_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three overlapping batches, the second one replayed, then folded into one."""
    path = new_path(spark, "orders-table")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    batch = lambda k, of: orders.where(of).select("o_orderkey", (F.col("o_totalprice") + 1000 * k).alias("price"), F.lit(k).alias("at"))
    second = F.col("o_orderkey") % 2 == 0
    commits.commit(batch(0, F.lit(True)), path, 0)
    commits.commit(batch(1, second), path, 1)
    commits.commit(batch(1, second), path, 1)
    commits.commit(batch(2, F.col("o_orderkey") % 3 == 0), path, 2)
    commits.compact(spark, path, "o_orderkey", "at")
    return commits.read(spark, path, "o_orderkey", "at").select("o_orderkey", F.round("price", 4).alias("price"), "at")


def _service(text: str) -> str | None:
    """Stands in for a model: refuses texts of some lengths."""
    if len(text) % 5 == 0:
        raise ValueError("refused")
    return f"{len(text)}:{text[:8]}"


def client_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents asked twice with one memo: answers, and errors for what is refused."""
    memo = new_path(spark, "memo")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    client.ask(docs.where(F.col("doc_id") % 2 == 0), _service, memo, retries=0)
    told = client.ask(docs, _service, memo, retries=0)
    return told.select("doc_id", F.md5("reply").alias("reply_md5"), "error")


def run_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents saved by runs with several inputs and thresholds, one of them cleared: what each run and
    the backup have then."""
    path = new_path(spark, "runs")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sample_hash"))
    parts = (("a0", 0.3, "doc_id % 2 = 0"), ("a0", 0.3, "doc_id % 2 = 1"), ("a0", 0.5, "doc_id % 3 = 0"), ("12", 0.3, "doc_id % 5 = 0"))
    for inputs, at, which in parts:
        results.save_run(docs.where(which), path, inputs, at)
    results.clear_run(spark, path, "a0", 0.5, "then")
    load = lambda where, inputs, at, name: results.load_run(spark, where, inputs, at).select(F.lit(name).alias("run"), "doc_id", "sample_hash")
    kept = load(path, "a0", 0.3, "a at 0.3").unionAll(load(path, "12", 0.3, "b at 0.3")).unionAll(load(path, "a0", 0.5, "a at 0.5"))
    return kept.unionAll(load(f"{path}.then.backup", "a0", 0.5, "backup"))


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in four files, two to a batch of the stream: how many batches and rows come out."""
    source, out, checkpoint = (new_path(spark, f"batches-{x}") for x in ("in", "out", "check"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    orders.repartition(4, "o_orderkey").write.parquet(source)
    files = resume.read_files(spark, source, orders.schema, files_per_batch=2)
    commits.run_commits(files, out, checkpoint, work=lambda batch: batch.withColumn("at", F.lit(0)))
    n = len(commits.manifest(spark, out).folders)
    return commits.read(spark, out, "o_orderkey", "at").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum")).withColumn("n_batches", F.lit(n))


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two runs of a stream that lets a user through once an hour: (user_id, run) with the
    run that the user came through in."""
    source, out, checkpoint = (new_path(spark, f"once-{x}") for x in ("in", "out", "check"))
    events = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 2).cast("int").alias("run"))
    for k in range(2):
        events.where(F.col("run") == k).write.mode("append").parquet(source)
        resume.run_available(resume.read_files(spark, source, events.schema), lambda rows: rows, out, checkpoint, "user_id", seconds=3600)
    return spark.read.parquet(out).select("user_id", "run")


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache fed by a stream: customers are written (one in five as a known absence, one in three not
    at all), and in the next run each order asks for its customer."""
    source, out, checkpoint = (new_path(spark, f"cache-{x}") for x in ("in", "out", "check"))
    name = F.when(F.col("c_custkey") % 5 > 0, F.col("c_name"))
    puts = read(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.lit(None).cast("long").alias("request_id"), F.col("c_custkey").alias("cache_key"), name.alias("payload"), F.lit(True).alias("is_put"))
    asks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("cache_key"), F.lit(None).cast("string").alias("payload"), F.lit(False).alias("is_put"))
    for rows in (puts, asks):
        rows.write.mode("append").parquet(source)
        state.append_available(state.cache(resume.read_files(spark, source, asks.schema), 3600), out, checkpoint)
    return spark.read.parquet(out).select("request_id", "cache_key", "payload", "hit")


REGISTRY = {
    "run_partitions": (
        run_partitions,
        "SELECT run, doc_id, md5(text) AS sample_hash FROM documents, (VALUES ('a at 0.3'), ('b at 0.3'), ('backup')) AS r(run) WHERE run = 'a at 0.3' OR (run = 'b at 0.3' AND doc_id % 5 = 0) OR (run = 'backup' AND doc_id % 3 = 0)",
    ),
    "stream_batches": (stream_batches, "SELECT count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, 2 AS n_batches FROM orders"),
    "stream_once": (stream_once, "SELECT user_id, CAST(min(event_id % 2) AS INT) AS run FROM events GROUP BY user_id"),
    "stream_cache": (
        stream_cache,
        "SELECT o_orderkey AS request_id, o_custkey AS cache_key, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS payload, c_custkey IS NOT NULL AS hit FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey",
    ),
    "commit_upserts": (
        commit_upserts,
        "SELECT o_orderkey, round(o_totalprice + 1000 * k, 4) AS price, k::INT AS at FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS k FROM orders)",
    ),
    "client_memo": (
        client_memo,
        "SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN md5(length(text) || ':' || substr(text, 1, 8)) END AS reply_md5, CASE WHEN length(text) % 5 = 0 THEN 'ValueError: refused' END AS error FROM documents",
    ),
}
