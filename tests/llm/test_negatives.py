"""Operator 12 against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import negatives


def brute(rows):
    told = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        told.append((i, [math.floor(256 * float(np.float32(v))) for v in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, (i, x, label) in enumerate(told):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, other == label) for m, (j, y, other) in enumerate(told) if m != n]
        scored.sort()
        for s, p, _ in [r for r in scored if r[2]][:5]:
            hard = [r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    df = df.withColumns({c: F.lit(c) for c in ("id", "row", "x", "dist", "near", "ring", "anchor", "slot", "score")})
    return sorted(tuple(r) for r in negatives.digest(df).collect())


def vectors(n, width, seed, labels=10):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[n // 2 :] = x[rng.integers(0, n // 2, n - n // 2)] + rng.normal(size=(n - n // 2, width)) * rng.choice([0, 0.01, 0.3], (n - n // 2, 1))
    return [(k, [float(v) for v in row], int(rng.integers(labels))) for k, row in enumerate(x)]


@pytest.mark.parametrize("width,labels", [(8, 10), (3, 2), (40, 10)])
def test_random_and_copies(spark, width, labels):
    rows = vectors(700, width, width, labels)
    assert mined(spark, rows) == brute(rows)


def test_small_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE", 20)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 1000)
    rows = vectors(900, 6, 5)
    assert mined(spark, rows) == brute(rows)


def test_nulls_ties_and_hot_vector(spark):
    rows = vectors(300, 4, 2)
    rows += [(k, [1.0, 0.5, 0.25, 0.0], k % 3) for k in range(300, 900)]  # one vector in a third of all labels
    rows += [(1000, None, 1), (1100, [1.0, None, 0.0, 0.0], 1), (1200, [math.nan] * 4, 1), (1300, [math.inf, 0.0, 0.0, 0.0], 1), (1400, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0] * 4, 2)]
    rows += [(1500, [], 1), (1600, [0.0, 0.0, 0.0, 0.0], 2), (1700, [-1.0, -1.0, -1.0, -1.0], 3), (1800, [2.0], 4)]
    random.Random(1).shuffle(rows)
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (3, [1.0, 0.0], 2)]
    assert mined(spark, rows) == [(100, 100, k, 3, 65536, 65536) for k in (1, 1, 2, 2)]


def test_large_components(spark):
    """Scores beyond 2**53 stay exact."""
    rows = [(k, [65_000.0 + k * 0.01 * j for j in range(40)], k % 4) for k in range(250)]
    assert mined(spark, rows) == brute(rows)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_blocks_are_left_out():
    """Clusters far apart: most pairs aren't scored."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(20, 16)).repeat(200, 0) * 400 + rng.normal(size=(4000, 16)) * 8).astype(np.int64)
    space = negatives.Space(16, np.float64, float((x * x).sum(1).max()))
    space.choose(x[::7])
    import pyarrow as pa

    dist = space.distances(x)
    a = pa.table({"row": np.arange(0, 4000, 100), "label": np.zeros(40, np.int64), "x": [v.tolist() for v in x[::100]], "near": dist[::100].argmin(1), "ring": dist[::100].min(1)})
    wanted = negatives.Wanted(space, a, True, 5, [(np.zeros(1, np.int64), np.array([np.sort(x @ v)[-8]]), np.array([2**62])) for v in x[::100]])
    scan = negatives.Scan(wanted)
    for k in range(0, 4000, 200):
        scan.block(x[k : k + 200].astype(float), dist[k : k + 200], np.zeros(200, np.int64), np.arange(k, k + 200), np.arange(k, k + 200))
    scan.settle()
    assert len(scan.kept[0]) == 40 * 5 and scan.scored < 0.5 * scan.pairs
