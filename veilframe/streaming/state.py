"""Keyed state that expires: rows are let through once for each key and time to live.

State stands in the RocksDB store of the stream's checkpoint, which spills to disk and is kept by key,
so it is bounded by the keys of one time to live, not by all keys ever seen. A key whose time has run
out leaves the state and comes through again. The time is that of the batch. Null is a key like any
other; rows of a key within a batch are streamed, and the first of them comes through.

Spark starts a worker of its own to set up such a query, which doesn't see this package unless it is
installed; so the processors go there by value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def expiring(spark: SparkSession) -> Iterator[None]:
    """Queries that start within have the store that state with a time to live needs, and no batches
    without data, which would never end: what expires leaves with the next batch that has some."""
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_available(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what the expiring stream `rows` has to a Parquet table, and stops."""
    with expiring(rows.sparkSession):
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class _FirstSeen(StatefulProcessor):
    def __init__(self, seconds: float):
        self.millis = max(1, int(seconds * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:
                pass
            return
        first = None
        for frame in rows:
            if first is None and len(frame):
                first = frame.head(1)
        if first is not None:
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_seen(source: DataFrame, key: str, seconds: float) -> DataFrame:
    """The rows of a stream whose key wasn't let through in the last `seconds`, one a key and batch; its
    query starts in `expiring`."""
    return source.groupBy(key).transformWithStateInPandas(_FirstSeen(seconds), outputStructType=source.schema, outputMode="Append", timeMode="ProcessingTime")


class _LastKnown(StatefulProcessor):
    """Keeps a payload for each key; a request without one in time is a miss."""

    def __init__(self, seconds: float, key: str, payload: str):
        self.millis, self.key, self.payload = max(1, int(seconds * 1000)), key, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "payload string", ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state is a round trip: one a key and batch, a write's or a read's
        told, asked = None, []
        for frame in rows:
            is_put = frame["is_put"].to_numpy(dtype=bool)
            if is_put.any():  # the last write of the batch counts, and requests of the batch see it
                last = frame[self.payload].iloc[int(is_put.nonzero()[0][-1])]
                told = (None if pd.isna(last) else last,)
            if not is_put.all():
                asked.append(frame if not is_put.any() else frame[~is_put])
        if told is not None:
            self.known.update(told)
        elif asked:
            told = self.known.get()  # None if there is none
        for frame in asked:
            yield pd.DataFrame({"request_id": frame["request_id"], self.key: frame[self.key], "payload": None if told is None else told[0], "hit": told is not None})

    def close(self) -> None:
        pass


def cache(traffic: DataFrame, seconds: float, key: str = "cache_key", payload: str = "payload") -> DataFrame:
    """(request_id, key, payload, hit) of the requests in a stream of requests and writes (request_id,
    key, payload, is_put). A write of null is a known absence: a hit without payload. A key that isn't
    written again in `seconds` leaves the cache. Its query starts in `expiring`."""
    fields = traffic.select("request_id", key).schema.fields
    schema = T.StructType([*fields, T.StructField("payload", T.StringType()), T.StructField("hit", T.BooleanType())])
    narrow = traffic.select("request_id", key, F.col(payload), F.col("is_put"))
    return narrow.groupBy(key).transformWithStateInPandas(_LastKnown(seconds, key, payload), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
