"""Hard-negative mining over a pivot table.

Components become whole numbers, so scores (inner products) are exact. A vector gets one more
component, sqrt(M - |x|^2) with M the largest squared norm, and an anchor a zero instead: then
|a' - x'|^2 = |a|^2 + M - 2 a.x, and a larger score is a smaller distance. Every row stores its
distances to a few pivots; by the triangle inequality |d(a,p) - d(x,p)| <= d(a,x) <= d(a,p) + d(x,p),
which brackets the score. Rows stand by nearest pivot and distance to it, so a block of rows has
narrow brackets: blocks and rows whose bracket misses what an anchor still wants are left out, the
scores of the others are computed exactly.

Anchors are a stated query set. They are broadcast in rounds of at most ANCHOR_BYTES, each round held
against all rows in blocks. A task keeps the best few of each anchor and raises what it wants as they
come in; to begin with, an anchor wants no less than it finds in a sample of SAMPLE rows, which decides
how much work is done but not what is found. Two rounds of scans give an anchor's positives, then the
negatives within each positive's window. Partial lists meet by anchor: a few rows from each task.

Rows whose id, label or vector is null, with a null or non-finite component, or with one beyond
LARGEST, take no part. Shorter vectors count as ended by zeros. Rows are told apart by place: those
with the same id or the same vector are each a row, ties in score and id in order of place. An empty
table, or one without anchors, has no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored

SCALE = 256.0
LARGEST = 1 << 24  # of a scaled component: sums of 2**15 products are then within a long
PIVOTS = 12
SAMPLE = 4096  # rows, by hash, from which pivots come and in which anchors look first
ANCHOR_BYTES = 16 << 20  # of the anchors of a round
BLOCK = 1024  # rows, and anchors, of which scores are computed at a time
PENDING = 200_000  # candidates that a task holds before it keeps the best
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "anchor long, slot int, score long, id long, row long"


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column, ended by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), kind)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), length)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


@dataclass
class Space:
    """What all vectors share: width, exact number type, M, pivots with their last component."""

    width: int
    kind: type
    most: float
    pivots: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """To each pivot, of rows (or of anchors, whose last component is zero)."""
        x = x.astype(np.float64)
        norm = (x * x).sum(1)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - norm, 0))
        p = self.pivots
        square = (norm + last * last)[:, None] + (p * p).sum(1) - 2 * (x @ p[:, :-1].T + last[:, None] * p[:, -1])
        return np.sqrt(np.maximum(square, 0))

    def choose(self, sample: np.ndarray) -> None:
        """Pivots far from each other: each is the row farthest from those before it."""
        x = sample.astype(np.float64)
        x = np.concatenate([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]], 1)
        chosen, far = [], np.full(len(x), np.inf)
        for _ in range(min(PIVOTS, len(x))):
            k = int(np.argmax(far)) if chosen else 0
            chosen.append(k)
            far = np.minimum(far, ((x - x[k]) ** 2).sum(1))
        self.pivots = x[chosen]

    def least_distance(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which an anchor of squared norm `square` has the score."""
        return np.sqrt(np.maximum(square + self.most - 2.0 * score, 0))


def prepared(rows: DataFrame, id: str, vector: str, label: Column, anchor: Column) -> DataFrame:
    """(row, id, label, anchor, x) of the rows that take part, x in whole numbers."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * SCALE))
    odd = F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * SCALE) >= LARGEST))
    some = rows.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.when(~odd, x.cast("array<int>")).alias("x"))
    return some.where("id is not null and label is not null and x is not null").select(F.monotonically_increasing_id().alias("row"), "*")


def pivot_table(rows: DataFrame) -> tuple[DataFrame, Space | None, pa.Table]:
    """The rows with `dist` to the pivots, in order of the nearest pivot and the distance to it; the
    space; the sample."""
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    stats = rows.agg(F.max(F.size("x")).alias("width"), F.max(square).alias("most"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    sample = rows.select("row", "id", "label", "x").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return rows, None, sample
    width, largest = max(1, stats["width"]), float(stats["largest"] or 0)
    exact = np.float32 if largest * largest * width < 1 << 24 else np.float64 if largest * largest * width < 1 << 53 else np.int64
    space = Space(width, exact, stats["most"])
    space.choose(_matrix(sample.column("x"), width, np.float64))
    names = [*rows.columns, "dist", "near", "ring"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist = space.distances(_matrix(batch.column(batch.schema.get_field_index("x")), width, np.float64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dist.size + 1, dist.shape[1], dtype=np.int32)), pa.array(dist.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(dist.argmin(1).astype(np.int32)), pa.array(dist.min(1))], names=names)

    told = stored(rows.mapInArrow(work, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, dist array<double>, near int, ring double"), "distances")
    order = ["near", "ring", "row"]
    return stored(told.repartitionByRange(*order).sortWithinPartitions(*order), "pivots"), space, sample


class Wanted:
    """The anchors of a round with their slots: each slot wants the best `count` rows of scores from
    `low` up to `high`, of the anchor's label or of others. Slots of an anchor are together."""

    def __init__(self, space: Space, anchors: pa.Table, same: bool, count: int, slots: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """slots: of each anchor, their numbers, lows and highs."""
        self.space, self.same, self.count = space, same, count
        x = _matrix(anchors.column("x"), space.width, np.float64)
        order = np.lexsort([anchors.column("ring").to_numpy(), anchors.column("near").to_numpy()])
        self.x = x[order].astype(space.kind)
        self.row = anchors.column("row").to_numpy()[order]
        self.label = anchors.column("label").to_numpy()[order]
        self.square = (x * x).sum(1)[order]
        self.dist = space.distances(x[order], anchors=True)
        some = [slots[k] for k in order.tolist()]
        self.first = np.concatenate([[0], np.cumsum([len(s[0]) for s in some])]).astype(np.int64)
        self.slot, self.low, self.high = (np.concatenate([s[k] for s in some]) if some else np.zeros(0, np.int64) for k in range(3))


class Scan:
    """A task's search: the best rows of each slot so far."""

    def __init__(self, wanted: Wanted):
        self.w, self.low = wanted, wanted.low.copy()
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]  # slot place, score, id, row
        self.pending: list[list[np.ndarray]] = []
        self.held = self.scored = self.pairs = 0
        self.limits()

    def limits(self) -> None:
        """The least and the largest score that each anchor wants; none if it has no slots."""
        w, n = self.w, len(self.w.row)
        self.cut, self.top = np.full(n, _MOST), np.full(n, _LEAST)
        some = np.flatnonzero(np.diff(w.first))
        if len(some):
            self.cut[some] = np.minimum.reduceat(self.low, w.first[some])
            self.top[some] = np.maximum.reduceat(w.high, w.first[some])

    def block(self, x: np.ndarray, dist: np.ndarray, label: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        w, space = self.w, self.w.space
        slack = 1e-6 * (1 + np.sqrt(space.most))
        self.pairs += len(x) * len(w.row)
        reach = space.least_distance(w.square, self.cut) + slack  # beyond it, scores are too small
        near = space.least_distance(w.square, self.top) - slack  # below it, too large
        gap = np.maximum(dist.min(0) - w.dist, w.dist - dist.max(0)).max(1)
        most = (w.dist + dist.max(0)).min(1)
        alive = np.flatnonzero((self.cut <= self.top) & (gap <= reach) & (most >= near))
        for k in range(0, len(alive), BLOCK):
            a = alive[k : k + BLOCK]
            lo, hi = w.dist[a].min(0), w.dist[a].max(0)
            some = np.flatnonzero(np.maximum(lo - dist, dist - hi).max(1) <= reach[a].max())
            if not len(some):
                continue
            self.scored += len(some) * len(a)
            scores = x[some] @ w.x[a].T
            hit = np.flatnonzero(scores >= self.cut[a].astype(scores.dtype))
            if not len(hit):
                continue
            r, c = some[hit // len(a)], a[hit % len(a)]
            score = scores.ravel()[hit].astype(np.int64)
            ok = ((label[r] == w.label[c]) == w.same) & (row[r] != w.row[c])
            r, c, score = r[ok], c[ok], score[ok]
            per = w.first[c + 1] - w.first[c]
            at = np.repeat(w.first[c] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            r, score = np.repeat(r, per), np.repeat(score, per)
            ok = (score >= self.low[at]) & (score <= w.high[at])
            if ok.any():
                self.pending.append([at[ok], score[ok], id[r[ok]], row[r[ok]]])
                self.held += int(ok.sum())
                if self.held > PENDING:
                    self.settle()

    def settle(self) -> None:
        """Keeps the best of each slot, and raises what full slots want."""
        if not self.pending:
            return
        slot, score, id, row = (np.concatenate([self.kept[k], *(p[k] for p in self.pending)]) for k in range(4))
        self.pending, self.held = [], 0
        order = np.lexsort([row, id, -score, slot])
        slot, score, id, row = slot[order], score[order], id[order], row[order]
        new = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(new, np.diff(np.append(new, len(slot))))
        full = np.flatnonzero(place == self.w.count - 1)
        self.low[slot[full]] = score[full]
        keep = place < self.w.count
        self.kept = [slot[keep], score[keep], id[keep], row[keep]]
        self.limits()

    def found(self) -> pa.RecordBatch:
        self.settle()
        slot, score, id, row = self.kept
        anchor = np.searchsorted(self.w.first, slot, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(self.w.row[anchor]), pa.array(self.w.slot[slot].astype(np.int32)), pa.array(score), pa.array(id), pa.array(row)], names=["anchor", "slot", "score", "id", "row"])


def _scan(table: DataFrame, wanted: Wanted) -> DataFrame:
    """(anchor, slot, rank, score, id, row): the best of every slot over all rows."""
    spark = table.sparkSession
    told = spark.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(told.value)
        width, kind = scan.w.space.width, scan.w.space.kind
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                row, id, label, x, dist = batch.slice(k, BLOCK).columns
                scan.block(_matrix(x, width, kind), _matrix(dist, len(scan.w.space.pivots), np.float64), label.to_numpy(), id.to_numpy(), row.to_numpy())
        yield scan.found()

    found = table.select("row", "id", "label", "x", "dist").mapInArrow(work, _FOUND)
    best = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    out = stored(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted.count), "best")
    told.destroy()
    return out


def _seeds(space: Space, sample: pa.Table, count: int, same: bool):
    """Adds `seeds`: what each slot finds in the sample at its place `count`, or its own low."""
    x = _matrix(sample.column("x"), space.width, space.kind)
    row, label = sample.column("row").to_numpy(), sample.column("label").to_numpy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                some = batch.slice(k, BLOCK)
                cols = dict(zip(some.schema.names, some.columns, strict=True))
                scores = (_matrix(cols["x"], space.width, space.kind) @ x.T).astype(np.int64)
                scores[((cols["label"].to_numpy()[:, None] == label) != same) | (cols["row"].to_numpy()[:, None] == row)] = _LEAST
                seeds = []
                for own, lows, highs in zip(scores, cols["lows"].to_pylist(), cols["highs"].to_pylist(), strict=True):
                    own = np.sort(own[own > _LEAST])
                    upto = np.searchsorted(own, highs, "right")
                    seeds.append([max(low, int(own[n - count])) if n >= count else low for low, n in zip(lows, upto.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(seeds, pa.list_(pa.int64()))], names=[*some.schema.names, "seeds"])

    return work


def _search(table: DataFrame, anchors: DataFrame, space: Space, sample: pa.Table, same: bool, count: int) -> DataFrame:
    """The best rows of the slots of a round's anchors (row, label, x, near, ring, slots, lows, highs)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    found = anchors.mapInArrow(_seeds(space, sample, count, same), f"{fields}, seeds array<long>").toArrow()
    slots = [(np.array(s, np.int64), np.array(low, np.int64), np.array(high, np.int64)) for s, low, high in zip(*(found.column(c).to_pylist() for c in ("slots", "seeds", "highs")), strict=True)]
    return _scan(table, Wanted(space, found, same, count, slots))


def mine(
    rows: DataFrame, id: str, vector: str, label: Column, anchor: Column, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (4, 5)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and
    each of its best `positives` rows of the same label, the best `negatives` rows of other labels whose
    scores are between `least` (a fraction) of the positive's score and that score."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    none = spark.createDataFrame([], schema)
    table, space, sample = pivot_table(stored(prepared(rows, id, vector, label, anchor), "vectors"))
    if space is None:
        return none
    chosen = table.where("anchor").select("row", "id", "label", "x", "near", "ring")
    each = max(1, ANCHOR_BYTES // (8 * (space.width + len(space.pivots)) + 64))
    rounds = -(-10 * chosen.count() // (9 * each))
    out = none
    for k in range(rounds):
        some = chosen.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)
        free = {"slots": F.array(F.lit(0)), "lows": F.array(F.lit(_LEAST)), "highs": F.array(F.lit(_MOST))}
        near = _search(table, some.withColumns(free), space, sample, True, positives)
        p, q = least
        low = F.expr(f"(score * {p} + {q - 1}) div {q}")  # of a score below zero, there is no window
        slot = near.where("score >= 0").withColumn("low", low).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "score"))).alias("s"))
        slot = slot.select(F.col("anchor").alias("row"), F.col("s.rank").alias("slots"), F.col("s.low").alias("lows"), F.col("s.score").alias("highs"))
        hard = _search(table, some.join(slot, "row"), space, sample, False, negatives)
        pairs = near.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = hard.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        told = found.join(pairs, ["anchor", "slot"]).join(some.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        out = out.unionByName(told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    return out


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: labels of every seventh id are moved by one, every hundredth id is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, "vec_id", "embedding", moved, F.col("vec_id") % 100 == 0)


#: The same rows by brute force, for vectors of equal length whose ids are unique.
SQL = """
WITH told AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM told a JOIN told b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
