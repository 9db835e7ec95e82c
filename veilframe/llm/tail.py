"""Sums of table values over the keys of each text, whatever the table's size.

A part of the table is broadcast. Keys that it lacks leave their texts once for each row, get their
values by joins, and are summed back to the rows. What is broadcast decides the cost, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .scratch import by_rows, shuffled, stored


class Hot:
    """The broadcast part: keys with a row of values each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.values = values
        self.directory = vec.Directory(vec.mix(keys))

    def find(self, key: np.ndarray) -> np.ndarray:
        return self.directory.find(vec.mix(key))


def hot(table: DataFrame, width: int) -> Hot:
    """From (key, v) with v an array of `width` numbers."""
    got = table.select("key", "v").toArrow()
    return Hot(got.column("key").to_numpy().view(np.uint64), got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width))


def summed(docs: DataFrame, keep: list[str], text: str, measure: Callable, table: Hot, resolve: Callable[[DataFrame], DataFrame], limit: int = vec.SLICE_BYTES) -> DataFrame:
    """(keep, size, letters, sums) of each row: how many keys it has, what `measure` counts, and the
    sum of their values. measure(slice) gives the keys, each row's first and a count for each row;
    resolve((key)) gives (key, v) for any keys."""
    width = table.values.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [*keep, "_row", "_size", "_letters", "_sums", "_key", "_times"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in vec.slices(batch.column(len(keep) + 1), limit):
                key, first, count = measure(part)
                at = table.find(key)
                known = at >= 0
                sums = np.zeros((part.rows, width))
                for k in range(width if len(table.values) else 0):
                    sums[:, k] = vec.row_sums(np.where(known, table.values[np.maximum(at, 0), k], 0.0), first)
                beyond = np.flatnonzero(~known)
                row = np.searchsorted(first, beyond, "right") - 1
                order = np.lexsort((key[beyond], row))
                row, rest = row[order], key[beyond[order]]
                lead = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (rest[1:] != rest[:-1])])) if len(row) else np.zeros(0, np.int64)
                m, n = len(lead), part.rows
                own = [c.slice(part.lo, n) for c in batch.columns[: len(keep) + 1]]
                pad = lambda values, m=m: pa.concat_arrays([values, pa.nulls(m, values.type)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pad(c) for c in own[:-1]),
                        pa.concat_arrays([own[-1], own[-1].take(pa.array(row[lead]))]),
                        pad(pa.array(np.diff(first).astype(np.int64))),
                        pad(pa.array(count.astype(np.int64))),
                        pad(lists),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rest[lead].view(np.int64))]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.diff(np.append(lead, len(row))).astype(np.int64))]),
                    ],
                    names=names,
                )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}{', ' if keep else ''}_row long, _size long, _letters long, _sums array<double>, _key long, _times long"
    told = stored(docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text")).mapInArrow(work, schema), "summed")
    rest = told.where("_key is not null").select("_row", F.col("_key").alias("key"), "_times")
    values = stored(resolve(rest.select("key").distinct()), "values")
    more = rest.join(by_rows(values), "key").groupBy("_row").agg(F.array(*(F.sum(F.col("_times") * F.col("v")[k]) for k in range(width))).alias("_more"))
    rows = told.where("_key is null").join(shuffled(more), "_row", "left")
    sums = F.when(F.col("_more").isNull(), F.col("_sums")).otherwise(F.zip_with("_sums", "_more", lambda a, b: a + b))
    return rows.select(*keep, F.col("_size").alias("size"), F.col("_letters").alias("letters"), sums.alias("sums"))
