"""Masking for a grid of k, and the choice of the k that pays best."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.constants import K_GRID, UNKNOWN_POPULATION
from . import ordered

SIGMA = 0.5


def mask_for_k(text: Column, qis: Column, k: Column) -> Column:
    """(text, n): QIs shared by fewer than k people are replaced by [REDACTED], from the last to the
    first; of overlapping ones the later stays. Ties on start go to the longer, then by type."""
    rare = F.filter(qis, lambda q: F.coalesce(q["population_count"], F.lit(UNKNOWN_POPULATION)) < k)
    spans = F.array_distinct(F.transform(rare, lambda q: F.struct((-q["start_pos"]).alias("back"), (-q["end_pos"]).alias("end"), q["qi_type"].alias("t"))))
    start = F.struct(text.alias("text"), F.lit(0).alias("n"), F.length(text).alias("last"))

    def step(a: Column, s: Column) -> Column:
        lo, hi = -s["back"], -s["end"]
        cut = F.concat(F.substring(a["text"], F.lit(1), lo), F.lit("[REDACTED]"), F.substring(a["text"], hi + 1, F.length(a["text"])))
        return F.when((hi <= a["last"]) & (hi > lo), F.struct(cut.alias("text"), (a["n"] + 1).alias("n"), lo.alias("last"))).otherwise(a)

    return F.aggregate(folds.ordered(spans), start, step, lambda a: F.struct(a["text"].alias("text"), a["n"].alias("n")))


def sweep(df: DataFrame, text: str = "text", qis: str = "qis", grid: tuple[int, ...] = K_GRID) -> DataFrame:
    """One row for each row and k: adds k, k_text and k_masked. The grid is an array, so no join."""
    out = df.withColumn("k", F.explode(F.array(*map(F.lit, grid)))).withColumn("_m", mask_for_k(F.col(text), F.col(qis), F.col("k")))
    return out.withColumns({"k_text": F.col("_m.text"), "k_masked": F.col("_m.n")}).drop("_m")


def as_maps(swept: DataFrame, id: str, score: str = "c_score") -> DataFrame:
    """(id, c_scores_by_k, masked_counts_by_k) with string keys."""
    key = F.col("k").cast("string")
    pairs = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(v).alias("v")))))
    return swept.groupBy(id).agg(pairs(score).alias("c_scores_by_k"), pairs("k_masked").alias("masked_counts_by_k"))


def by_k(swept: DataFrame, score: str = "c_score", base: str = "c_original") -> DataFrame:
    """Mean and deviation of score and masked count, and mean reduction from the base, for each k."""
    return swept.groupBy("k").agg(
        F.avg(score).alias("c_mean"), F.stddev_pop(score).alias("c_std"), F.avg("k_masked").alias("masked_mean"), F.stddev_pop("k_masked").alias("masked_std"), F.avg(F.col(base) - F.col(score)).alias("reduction"), F.avg(base).alias("baseline")
    )


def gains(table: DataFrame) -> DataFrame:
    """Adds gain (baseline less mean score) and its share of the largest. The table has a row a k."""
    gain = F.col("baseline") - F.col("c_mean")
    whole = W.partitionBy(F.lit(0))
    return table.withColumn("gain", gain).withColumns({"gain_norm": F.col("gain") / (F.max("gain").over(whole) + 1e-9), "masked_norm": F.col("masked_mean") / (F.max("masked_mean").over(whole) + 1e-9)})


def knee(table: DataFrame) -> DataFrame:
    """Adds curvature of the smoothed gain over log10 k, null at both ends. Rows of the grid become
    one array, so that neighbours are places in it."""
    weights = [exp(-(x * x) / (2 * SIGMA * SIGMA)) for x in range(-2, 3)]
    total = sum(weights)
    rows = gains(table).groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "gain_norm"))).alias("r"))
    n = F.size("r")
    log = lambda i: F.log10(F.get("r", i)["k"].cast("double"))
    rows = rows.withColumn("x", F.transform("r", lambda v, i: (log(i) - log(F.lit(0))) / (log(n - 1) - log(F.lit(0)))))
    inside = lambda i: F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)  # noqa: E731  the ends are mirrored
    smooth = lambda v, i: sum((F.lit(w / total) * F.get("r", inside(i + d))["gain_norm"] for w, d in zip(weights[1:], range(-1, 3), strict=True)), F.lit(weights[0] / total) * F.get("r", inside(i - 2))["gain_norm"])
    rows = rows.withColumn("y", F.transform("r", smooth))

    def gradient(f: str) -> Column:
        at = lambda c, i: F.get(c, i)

        def slope(v: Column, i: Column) -> Column:
            hs, hd = at("x", i) - at("x", i - 1), at("x", i + 1) - at("x", i)
            middle = (hs * hs * at(f, i + 1) + (hd * hd - hs * hs) * at(f, i) - hd * hd * at(f, i - 1)) / (hs * hd * (hs + hd))
            first = (at(f, i + 1) - at(f, i)) / (at("x", i + 1) - at("x", i))
            last = (at(f, i) - at(f, i - 1)) / (at("x", i) - at("x", i - 1))
            return F.when(i == 0, first).when(i == n - 1, last).otherwise(middle)

        return F.transform("x", slope)

    rows = rows.withColumn("d1", gradient("y")).withColumn("d2", gradient("d1"))
    out = rows.select(n.alias("n"), F.posexplode("r").alias("i", "row"), "d1", "d2")
    curve = F.abs(F.get("d2", F.col("i"))) / F.pow(1 + F.pow(F.get("d1", F.col("i")), 2), 1.5)
    return out.select(F.col("row.k").alias("k"), F.when((F.col("i") > 0) & (F.col("i") < F.col("n") - 1), curve).alias("curvature"))


def optimal(table: DataFrame) -> DataFrame:
    """(method, k) of four methods: knee (recommended), efficiency, target, pareto."""
    g = gains(table)
    first = lambda df, *order: df.orderBy(*order).limit(1).select("k")
    bend = first(knee(table).where("curvature is not null"), F.desc("curvature"), "k")
    pays = first(g.withColumn("e", F.col("gain") / (F.col("masked_mean") + 1)), F.desc("e"), "k")
    half = g.groupBy().agg(F.max("gain").alias("m"), F.max("k").alias("last"))
    reach = g.crossJoin(F.broadcast(half)).groupBy().agg(F.coalesce(F.min(F.when(F.col("gain") >= 0.5 * F.col("m"), F.col("k"))), F.max("last")).alias("k"))
    front = pareto(table).groupBy().agg(F.array_sort(F.collect_list("k")).alias("ks")).select(F.get("ks", F.floor(F.size("ks") / 2).cast("int")).alias("k"))
    named = [("knee", bend), ("efficiency", pays), ("target", reach), ("pareto", front)]
    out = None
    for method, df in named:
        row = df.select(F.lit(method).alias("method"), F.col("k").cast("long").alias("k"), F.lit(method == "knee").alias("recommended"))
        out = row if out is None else out.unionByName(row)
    return out


def pareto(table: DataFrame) -> DataFrame:
    """Rows that no other beats: none has at least the gain for at most the masking with one of them
    strictly better. The table has a row a k."""
    return ordered.unbeaten(gains(table), "masked_mean", "gain")
