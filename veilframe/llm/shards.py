"""Sharding by histogram sort: exact byte counts steer the splitters, then rows move once.

Law `bytes`: rows are ordered by (hash of the text, place), the order is cut into ranges of nearly
equal bytes, and some adjoining ranges make a shard. No row is sampled. Each round asks for the
exact bytes in the bins of the current probes and refines only the bins that hold a splitter,
until the splitter is within the tolerance. A splitter goes between two texts where that keeps
the tolerance, so equal texts stay in one shard; a larger group of equal texts is split by place, a
number that each row gets once. So ids may be null or repeat.

What the rounds read is (place, hash, size), written once to the shared folder; the driver sees the
sums of a fixed number of bins. An empty table has no rows out. A null text has one byte and the
hash of the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored

BINS = 256  # bins into which a round splits each open interval
FEW = 512  # an interval of so few rows is fetched and cut by its rows
TOLERANCE = 0.002  # of a shard's bytes
RANGE_BYTES = 64 << 20  # wanted size of a range
MAX_RANGES = 4096
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Splitter:
    """The interval [low, high] of keys in which the splitter lies: `below` bytes stand before it
    and `count` rows in it."""

    target: float
    below: int = 0
    low: int = _LEAST
    high: int = _MOST
    count: int = 1 << 62

    def near(self, slack: float) -> bool:
        return self.target - self.below <= slack


def _probes(spans: list[tuple[int, int]]) -> np.ndarray:
    """BINS bin starts in each of the disjoint, sorted spans, and one beyond each span."""
    edges: set[int] = set()
    for low, high in spans:
        width = max(1, -(-(high - low + 1) // BINS))
        edges.update(range(low, high + 1, width))
        if high < _MOST:
            edges.add(high + 1)
    return np.array(sorted(edges), np.int64)


def histogram(rows: DataFrame, key: str, probes: np.ndarray) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) from each probe up to the next, by probe number; keys below the first
    probe count under -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), "right")
            size = np.zeros(len(probes) + 1, np.int64)
            np.add.at(size, at, batch.column(1).to_numpy())
            count = np.bincount(at, minlength=len(probes) + 1)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some - 1), pa.array(size[some]), pa.array(count[some])], names=["bin", "size", "n"])

    parts = rows.select(key, "size").mapInArrow(work, "bin long, size long, n long")
    got = parts.groupBy("bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    return {r["bin"]: (r["size"], r["n"]) for r in got}


def _narrow(rows: DataFrame, key: str, splitters: list[Splitter], slack: float, floor: int = 0) -> None:
    """Refines each splitter's interval of `key` until the bytes before it are within the
    tolerance, or few rows or one key are left in it. `floor` bytes stand before all rows."""
    while open_ := [s for s in splitters if not s.near(slack) and s.count > FEW and s.low < s.high]:
        probes = _probes(sorted({(s.low, s.high) for s in open_}))
        found = histogram(rows, key, probes)
        below, k = floor + found.get(-1, (0, 0))[0], 0
        for s in sorted(open_, key=lambda s: s.target):
            while k < len(probes) - 1 and below + found.get(k, (0, 0))[0] <= s.target:
                below += found.get(k, (0, 0))[0]
                k += 1
            s.below, s.count = below, found.get(k, (0, 0))[1]
            s.low, s.high = int(probes[k]), int(probes[k + 1]) - 1 if k + 1 < len(probes) else _MOST


def splitters(rows: DataFrame, parts: int, total: int, slack: float) -> list[tuple[int, int]]:
    """parts - 1 splitters (hash, place): a row stands before one if its (hash, place) is less."""
    cuts = [Splitter(total * k / parts) for k in range(1, parts)]
    _narrow(rows, "hash", cuts, slack)
    ends: dict[int, tuple[int, int]] = {}
    rest: list[tuple[int, Splitter, int | None]] = []
    for k, s in enumerate(cuts):
        if s.near(slack):
            ends[k] = (s.low, _LEAST)
        elif s.low < s.high or s.count <= FEW:
            rest.append((k, s, None))
        else:  # a large group of equal texts
            group = rows.where(F.col("hash") == s.low)
            size = group.agg(F.sum("size")).first()[0]
            if s.below + size - s.target <= slack and s.low < _MOST:
                ends[k] = (s.low + 1, _LEAST)
            else:
                inner = Splitter(s.target, s.below)
                _narrow(group, "place", [inner], 0, s.below)
                rest.append((k, inner, s.low))
    if rest:
        within = F.lit(False)
        for _, s, h in rest:
            within |= F.col("hash").between(s.low, s.high) if h is None else (F.col("hash") == h) & F.col("place").between(s.low, s.high)
        near = sorted((r["hash"], r["place"], r["size"]) for r in rows.where(within).select("hash", "place", "size").collect())  # FEW rows for each splitter
        for k, s, h in rest:
            mine = [r for r in near if (s.low <= r[0] <= s.high if h is None else r[0] == h and s.low <= r[1] <= s.high)]
            edges, below = [], s.below
            for i, (a, b, size) in enumerate(mine):
                new = i > 0 and mine[i - 1][0] != a or i == 0 and h is None
                edges.append((abs(below - s.target), not new, (a, _LEAST) if new else (a, b)))
                below += size
            if mine:
                a, b, _ = mine[-1]
                edges.append((abs(below - s.target), h is not None, (a, b + 1) if h is not None or a == _MOST else (a + 1, _LEAST)))
            between = [e for e in edges if not e[1] and e[0] <= slack]
            ends[k] = min(between or edges, default=(0, False, (s.low, _LEAST)))[2]
    return sorted(ends.values())


def _ranged(rows: DataFrame, ends: list[tuple[int, int]]) -> DataFrame:
    """Adds `range`, the number of splitters at or before the row."""
    hashes, places = np.array([h for h, _ in ends], np.int64), np.array([i for _, i in ends], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, place = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            at, upto = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            same = np.flatnonzero(at < upto)  # rows of a text that has splitters
            for low in np.unique(at[same]).tolist():
                rows = same[at[same] == low]
                at[rows] = low + np.searchsorted(places[low : upto[rows[0]]], place[rows], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    return rows.select("place", "hash", "size", "text_crc32", "id").mapInArrow(work, f"place long, hash long, size long, text_crc32 long, id {rows.schema['id'].dataType.simpleString()}, range int")


def assign(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row. Slots count from 0 in each shard, in
    (hash, place) order."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(F.monotonically_increasing_id().alias("place"), F.col(id).alias("id"), F.xxhash64(body).alias("hash"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")),
        "shard-keys",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = max(1, min(-(-total // (RANGE_BYTES * shards)), MAX_RANGES // shards))
    ends = splitters(rows, shards * each, total, tolerance * total / shards) if total else []
    ranged = _ranged(rows, ends)
    begin, upto, shard = [0] * (len(ends) + 1), 0, -1
    for r in sorted(ranged.groupBy("range").count().collect()):  # at most MAX_RANGES
        shard, upto = r[0] // each, upto if r[0] // each == shard else 0
        begin[r[0]] = upto
        upto += r[1]
    place = F.row_number().over(W.partitionBy("range").orderBy("hash", "place")) - 1 + F.get(F.lit(begin), F.col("range"))
    return ranged.select(F.col("id").alias(id), "size", "text_crc32", F.floor(F.col("range") / each).cast("int").alias("shard"), place.cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text") -> None:
    """Writes whole rows in folders shard=0, 1, ..., each sorted by slot; columns `shard` and `slot` are
    replaced. Rows are numbered once, so none is lost or doubled whatever its id."""
    rows = stored(docs.drop("shard", "slot").withColumn("_place", F.monotonically_increasing_id()), "rows")
    placed = rows.join(assign(rows, shards, "_place", text).select("_place", "shard", "slot"), "_place").drop("_place")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
