"""Incremental runs as streams: what is new is processed once, in batches, and can stop anywhere."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import append_available, first_seen


def run_available(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str | None = None, seconds: float | None = None) -> None:
    """Processes all that `source` (a stream) has, appends to the Parquet table `out`, and stops.
    Run again, it goes on from the checkpoint. With a key, rows whose key was seen are dropped: in the
    last `seconds`, or ever, if that isn't given, when the state keeps every key."""
    if key and seconds:
        return append_available(work(first_seen(source, key, seconds)), out, checkpoint)
    rows = source.dropDuplicates([key]) if key else source
    query = work(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_complete(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Keeps the whole of an aggregate of a stream: each batch that has news writes a version of the
    table, in its own folder, so that a batch that is run again writes the same one."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last version of a table of `run_complete`."""
    every = spark.read.parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")


def stop_gracefully(query, seconds: float | None = None, poll: float = 0.05) -> bool:
    """Lets the batch at hand end, for at most `seconds`, and stops the stream, also while input keeps
    coming; whether the stream had ended by itself. A batch that began meanwhile is cut off and runs
    again at the next start."""
    done = lambda: (query.lastProgress or {}).get("batchId", -1)
    began, until = done(), None if seconds is None else time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and done() == began and (until is None or time.monotonic() < until):
        time.sleep(poll)
    ended = not query.isActive
    query.stop()
    return ended


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def windowed(events: DataFrame, ts: str, flag, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of rows and flagged rows by window, as a stream or a batch; an extension."""
    zoned = events.withColumn(ts, F.col(ts).cast("timestamp")) if events.isStreaming else events  # a watermark needs a zone
    counted = zoned.withWatermark(ts, late) if events.isStreaming else events
    return counted.groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged")).select(F.col("window.start").cast(events.schema[ts].dataType).alias("window_start"), "n", "n_flagged")
