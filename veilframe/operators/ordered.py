"""What depends on the order of all rows, without a task that has them all: quantiles, running sums
and maxima, and the rows that no other beats.

Quantiles are selected exactly: rows are counted in bins between the least and the largest value, and
the bin that holds the wanted rank is cut into bins again, until few values are left in it. Running
values come in two passes over ranges: sums within each range, and a table of what the ranges before
add, a row a range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import literal
from ..sources.shared import stored

BINS = 256
FEW = 1000  # values of a bin that are fetched and sorted
SMALL = 100_000  # values of a group that one buffer may hold
OPEN = 200  # ranks that are looked for at a time


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], small: int = SMALL) -> DataFrame:
    """(keys, q): the quantiles of the values of each group, interpolated between neighbours; nulls
    don't count, a group of nulls has a null, NaN is larger than all numbers. Groups of at most `small`
    values are sorted in a buffer of that size, larger ones are selected from: there are at most as many
    as blocks of `small` rows."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = stored(rows.groupBy(*keys).agg(F.count("_v").alias("_n")), "group-sizes")
    large = [r.asDict() for r in sizes.where(F.col("_n") > small).collect()]
    asked = F.array(*map(F.lit, shares))
    if not large:
        return rows.groupBy(*keys).agg(F.percentile("_v", asked).alias("q"))
    names = [f"_k{i}" for i in range(len(keys))]
    schema = T.StructType([*(T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys, strict=True)), T.StructField("_g", T.IntegerType())])
    groups = df.sparkSession.createDataFrame([(*(g[k] for k in keys), i) for i, g in enumerate(large)], schema)
    same = F.lit(True)
    for n, k in zip(names, keys, strict=True):
        same = same & rows[k].eqNullSafe(groups[n])
    few = rows.join(F.broadcast(groups), same, "left_anti").groupBy(*keys).agg(F.percentile("_v", asked).alias("q"))
    many = stored(rows.join(F.broadcast(groups), same).where("_v is not null").select("_g", "_v"), "large-groups")
    ranks = {i: sorted({k for s in shares for k in (math.floor(s * (g["_n"] - 1)), math.ceil(s * (g["_n"] - 1)))}) for i, g in enumerate(large)}
    wanted = [(i, k) for i in ranks for k in ranks[i]]
    found: dict[tuple[int, int], float] = {}
    for k in range(0, len(wanted), OPEN):
        found |= _select(many, wanted[k : k + OPEN])
    told = []
    for i, g in enumerate(large):
        q = []
        for s in shares:
            at = s * (g["_n"] - 1)
            lo, hi = found[i, math.floor(at)], found[i, math.ceil(at)]
            q.append(lo if lo == hi or math.isnan(lo) else lo + (at - math.floor(at)) * (hi - lo))
        told.append((i, q))
    out = df.sparkSession.createDataFrame(told, "_g int, q array<double>").join(groups, "_g")
    return few.unionByName(out.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "q"))


def _select(rows: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The values at the ranks (group, rank from 0) of the rows (_g, _v)."""
    spark, inf, found = rows.sparkSession, float("inf"), {}
    finite = ~F.isnan("_v") & (F.abs("_v") < inf)
    own = F.when(finite, F.col("_v"))
    ends = {r["_g"]: r for r in rows.groupBy("_g").agg(F.count_if(F.col("_v") == -inf).alias("low"), F.count(own).alias("n"), F.count_if(F.col("_v") == inf).alias("high"), F.min(own).alias("lo"), F.max(own).alias("hi")).collect()}
    open_: dict[tuple[int, int], tuple[float, float, int, int]] = {}  # least and largest value, rows before, rows between
    for g, k in wanted:
        e = ends[g]
        if k < e["low"]:
            found[g, k] = -inf
        elif k < e["low"] + e["n"]:
            open_[g, k] = (e["lo"], e["hi"], e["low"], e["n"])
        else:
            found[g, k] = inf if k < e["low"] + e["n"] + e["high"] else math.nan
    finite_rows = rows.where(finite)
    while True:
        for key, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                found[key] = lo
                del open_[key]
        cut = {(g, lo, hi) for (g, _), (lo, hi, _, n) in open_.items() if n > FEW}
        if not cut:
            break
        spans = literal.table(spark, [(g, lo, hi) for g, lo, hi in sorted(cut)], "_g int, _lo double, _hi double")
        # halves, where the whole span is beyond a double; each step keeps the order of values
        share = F.when(F.col("_hi") - F.col("_lo") < inf, (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2))
        at = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        inside = finite_rows.join(F.broadcast(spans), "_g").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        bins = inside.groupBy("_g", "_lo", "_hi", at.alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
        by: dict[tuple[int, float, float], list] = {}
        for b in sorted(bins, key=lambda b: b["_b"]):
            by.setdefault((b["_g"], b["_lo"], b["_hi"]), []).append(b)
        for (g, k), (lo, hi, before, n) in list(open_.items()):
            if n > FEW:
                for b in by[g, lo, hi]:
                    if k < before + b["n"]:
                        open_[g, k] = (b["lo"], b["hi"], before, b["n"])
                        break
                    before += b["n"]
    if open_:
        spans = literal.table(spark, sorted({(g, lo, hi) for (g, _), (lo, hi, _, _) in open_.items()}), "_g int, _lo double, _hi double")
        left = finite_rows.join(F.broadcast(spans), "_g").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        values = {(r["_g"], r["_lo"], r["_hi"]): r["v"] for r in left.groupBy("_g", "_lo", "_hi").agg(F.array_sort(F.collect_list("_v")).alias("v")).collect()}  # FEW of each
        for (g, k), (lo, hi, before, _) in open_.items():
            found[g, k] = values[g, lo, hi][k - before]
    return found


_OPS = {"sum": (np.cumsum, F.sum, lambda a, b: a + b), "max": (np.maximum.accumulate, F.max, max)}


def running(df: DataFrame, order: Sequence[str | Column], **columns: tuple[str, Column]) -> DataFrame:
    """Adds columns that run over the whole order: each is ("sum" or "max", a number, null for nothing);
    a row's value counts itself. The order should be total; nulls come first, and equal keys in any
    order. Two passes: within ranges, then what the ranges before them come to."""
    ops, own = [op for op, _ in columns.values()], [f"_v{k}" for k in range(len(columns))]
    keys = [f"_o{k}" for k in range(len(order))]
    sums = [F.coalesce(c.cast("double"), F.lit(0.0 if op == "sum" else -math.inf)) for op, c in columns.values()]
    keyed = df.select("*", *(F.col(o).alias(k) if isinstance(o, str) else o.alias(k) for o, k in zip(order, keys, strict=True)), *(s.alias(v) for s, v in zip(sums, own, strict=True)))
    sorted_ = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    schema = T.StructType([*sorted_.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType())])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last = TaskContext.get().partitionId(), 0, [0.0 if op == "sum" else -np.inf for op in ops]
        for batch in batches:
            if not batch.num_rows:
                continue
            head, tail = batch.columns[: -len(own)], []
            for k, c in enumerate(batch.columns[-len(own) :]):
                v = c.to_numpy(zero_copy_only=False).copy()
                v[0] = v[0] + last[k] if ops[k] == "sum" else max(v[0], last[k])
                v = _OPS[ops[k]][0](v)
                last[k] = v[-1]
                tail.append(pa.array(v))
            yield pa.RecordBatch.from_arrays([*head, *tail, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(row, row + batch.num_rows))], names=names)
            row += batch.num_rows

    done = stored(sorted_.mapInArrow(work, schema), "running")
    ends = sorted(done.groupBy("_part").agg(F.max_by(F.struct(*own), "_row").alias("l")).select("_part", "l.*").collect())
    before, table = [0.0 if op == "sum" else -math.inf for op in ops], []
    for r in ends:  # a row a range
        table.append((r["_part"], *before))
        before = [_OPS[op][2](b, r[v]) for op, b, v in zip(ops, before, own, strict=True)]
    lead = [f"_b{k}" for k in range(len(own))]
    told = done.join(F.broadcast(df.sparkSession.createDataFrame(table, f"_part int, {', '.join(f'{b} double' for b in lead)}")), "_part")
    whole = {name: F.col(b) + F.col(v) if op == "sum" else F.greatest(b, v) for name, op, b, v in zip(columns, ops, lead, own, strict=True)}
    return told.withColumns(whole).select(*df.columns, *columns)


def unbeaten(df: DataFrame, low: str, high: str) -> DataFrame:
    """The rows that no other beats: none has at most their `low` and at least their `high`, one of
    them strictly. Equal rows stay together. Rows with a null or NaN stay out.

    Of each `low` only the largest `high` counts, and of those only what is larger than at all
    smaller ones: a running maximum."""
    told = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    some = df.where(told(low) & told(high))
    best = some.groupBy(F.col(low).cast("double").alias("_low")).agg(F.max(F.col(high).cast("double")).alias("_high"))
    swept = running(best, ["_low"], _most=("max", F.col("_high")))
    # the running maximum counts the row itself: it stands out if it is reached here first
    first = swept.groupBy("_most").agg(F.min("_low").alias("_low")).withColumnRenamed("_most", "_high")
    return some.join(first, (F.col(low).cast("double") == F.col("_low")) & (F.col(high).cast("double") == F.col("_high")), "left_semi")
