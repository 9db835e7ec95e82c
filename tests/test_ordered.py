"""Order statistics against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import evaluate, ordered

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def rows_of(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double").repartition(3)


GROUPS = {
    "even": [float(v) for v in range(5000)],
    "skewed": [math.exp(v / 50) for v in range(4000)] + [-1e300, 1e300, 1e-300, 5e-324, 0.0],
    "wide": [(-1.0) ** k * 1.7e308 / (k + 1) for k in range(3000)],
    "one value": [2.5] * 3000,
    "copies": [1.0] * 2000 + [2.0] * 1500 + [float(k) for k in range(10, 60)],
    "small": [3.0, 1.0, 2.0],
    None: [float(k % 7) for k in range(2600)],
}


@pytest.mark.parametrize("small", [0, 2500, 100_000])
def test_quantiles(spark, small):
    df = rows_of(spark, GROUPS).unionByName(spark.createDataFrame([("even", None), ("none", None)], "k string, v double"))
    got = {r["k"]: r["q"] for r in ordered.quantiles(df, ["k"], "v", SHARES, small).collect()}
    assert set(got) == {*GROUPS, "none"} and not any(got["none"] or [])
    for k, values in GROUPS.items():
        v = sorted(values)
        for s, q in zip(SHARES, got[k], strict=True):
            at = s * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            assert q == pytest.approx(lo + (at - math.floor(at)) * (hi - lo), rel=1e-12), (k, s)


def test_quantiles_with_infinities_and_nan(spark):
    values = [-math.inf] * 5 + [float(k) for k in range(3000)] + [math.inf] * 5 + [math.nan] * 10
    got = ordered.quantiles(rows_of(spark, {"x": values}), ["k"], "v", (0.0, 0.5, 3007 / 3019, 1.0), small=10).first()["q"]
    assert got[0] == -math.inf and got[1] == 1504.5 and got[2] == math.inf and math.isnan(got[3])


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_running(spark, n):
    rng = np.random.default_rng(2)
    rows = [(int(k), 7, float(rng.integers(-5, 6)) if k % 11 else None) for k in rng.permutation(n)]
    df = spark.createDataFrame(rows, "id long, day int, v double").repartition(4)
    got = {r["id"]: (r["total"], r["most"]) for r in ordered.running(df, ["day", "id"], total=("sum", F.col("v")), most=("max", F.col("v"))).collect()}
    total, most, want = 0.0, -math.inf, {}
    for k, _, v in sorted(rows):
        total, most = total + (v or 0), max(most, -math.inf if v is None else v)
        want[k] = (total, most)
    assert got == want


def test_a_single_day_is_spread_over_tasks(spark):
    df = spark.range(20_000).select("id", F.lit("2024-01-01").alias("day"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = evaluate.running_count(df.withColumn("_keep", F.lit(1)), F.col("id") % 2 == 0, ["day", "id"])
        assert out.agg(F.max("n"), F.max("n_flagged")).first()[:] == (20_000, 10_000)
        sizes = [r["count"] for r in df.repartitionByRange("day", "id").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("seed", [1, 2])
def test_unbeaten(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, float(rng.integers(40)), float(rng.integers(40))) for k in range(800)] + [(900, None, 50.0), (901, 0.0, math.nan)]
    got = {r["id"] for r in ordered.unbeaten(spark.createDataFrame(rows, "id int, low double, high double"), "low", "high").collect()}
    beats = lambda b, a: b[1] <= a[1] and b[2] >= a[2] and (b[1] < a[1] or b[2] > a[2])
    assert got == {a[0] for a in rows[:800] if not any(beats(b, a) for b in rows[:800])}


def test_thresholds_leave_out_missing_scores(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True), (math.nan, True), (None, False)], "s double, y boolean")
    assert evaluate.threshold_search(df, "s", "y").first()["separation"] == 2
    met = {r["i"]: r for r in evaluate.threshold_metrics(df, "s", "y").collect()}
    assert len(met) == 50 and met[0]["recall"] == 1 and met[0]["fpr"] == 1 and met[49]["recall"] == 0 and met[49]["precision"] == 1
    none = df.where("false")
    assert len(evaluate.threshold_metrics(none, "s", "y").collect()) == 50
