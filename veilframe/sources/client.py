"""A client of a model or service around a callable, with a memo that outlives the run.

Each distinct text that the memo doesn't know is asked once: in Arrow batches, a few requests at a time,
each with a time limit and retries. An answer goes to the memo; a failure becomes an error row, and is
asked again by the next run. A null text is not asked and has no answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import commits
from .shared import stored

ANSWER = "text_hash string, reply string, error string, attempts int"


def answers(texts: DataFrame, call: Callable[[str], str | None], timeout: float = 60.0, retries: int = 2, wait: float = 0.5, at_once: int = 8, text: str = "text") -> DataFrame:
    """(text_hash, reply, error, attempts) of each row's text. A call that raises or takes longer than
    `timeout` seconds is tried again `retries` times, after `wait` seconds, twice as long each time."""

    def one(pool: ThreadPoolExecutor, body: str) -> tuple[str | None, str | None, int]:
        error = ""
        for k in range(retries + 1):
            if k:
                time.sleep(wait * 2 ** (k - 1))
            try:
                return pool.submit(call, body).result(timeout), None, k + 1
            except Late:
                error = f"no answer in {timeout:g} s"
            except Exception as e:  # whatever the service raises becomes a row
                error = f"{type(e).__name__}: {e}"
        return None, error, retries + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one pool watches, the other calls: a call beyond its time keeps its thread, not its row
        watch, calls = ThreadPoolExecutor(at_once), ThreadPoolExecutor(at_once * (retries + 1))
        try:
            for batch in batches:
                told = list(watch.map(lambda body: one(calls, body), batch.column(1).to_pylist()))
                reply, error, attempts = ([t[k] for t in told] for k in range(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reply, pa.string()), pa.array(error, pa.string()), pa.array(attempts, pa.int32())], names=["text_hash", "reply", "error", "attempts"])
        finally:
            watch.shutdown(wait=False, cancel_futures=True)
            calls.shutdown(wait=False, cancel_futures=True)

    return texts.select("text_hash", text).mapInArrow(work, ANSWER)


def ask(df: DataFrame, call: Callable[[str], str | None], memo: str, text: str = "text", **how) -> DataFrame:
    """Adds reply and error to each row. `memo` is the path of a table that `commits` keeps; it gets
    the answers of this run, no failure. A text that is answered there isn't asked."""
    spark = df.sparkSession
    hashed = df.withColumn("text_hash", F.sha2(F.col(text), 256))
    asked = hashed.where(F.col(text).isNotNull()).select("text_hash", F.col(text).alias("_text")).dropDuplicates(["text_hash"])
    known = commits.read(spark, memo, "text_hash", "attempts")
    if known is not None:
        asked = asked.join(known.select("text_hash"), "text_hash", "left_anti")
    told = stored(answers(asked, call, text="_text", **how), "answers")
    new = told.where("error is null").select("text_hash", "reply", "attempts")
    number = commits.manifest(spark, memo).number
    commits.commit(new, memo, number, "answers")
    every = told.select("text_hash", "reply", "error")
    if known is not None:
        every = every.unionByName(known.select("text_hash", "reply", F.lit(None).cast("string").alias("error")))
    return hashed.join(every, "text_hash", "left").drop("text_hash")
