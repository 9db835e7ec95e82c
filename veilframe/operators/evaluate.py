"""Evaluation of scores against labels: correlations, thresholds, curves, bins.

All of it is aggregation: one pass with many aggregates, or a pass over distinct scores. Where
thresholds meet data, the data is first counted between thresholds. Rows whose score is null or NaN
don't count there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folds
from ..sources import literal
from . import ordered


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(label)).alias("n_sensitive"), F.count_if(~F.col(label)).alias("n_not_sensitive"))


def _corr(x: Column, y: Column, none: float = 0.0) -> Column:
    """Pearson's r; `none` for fewer than two rows or no variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) >= 2) & (spread > 1e-15), F.try_divide(F.covar_pop(x, y), spread)).otherwise(F.lit(none))


def _pairwise(df: DataFrame, pairs: Sequence[tuple[Column, Column]], none: float = 0.0) -> DataFrame:
    """(ord, corr) of each pair of columns, in one pass: a row gives a short row for each pair, which meets the others of
    its pair before any shuffle. As one row of aggregates, hundreds of them would be one method that is never compiled."""
    values = F.array(*(F.struct(F.lit(k).alias("ord"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(pairs)))
    met = df.select(F.inline(values)).groupBy("ord").agg(_corr(F.col("x"), F.col("y"), none).alias("corr"), F.lit(True).alias("met"))
    every = literal.table(df.sparkSession, [(k,) for k in range(len(pairs))], "ord int")  # without rows, pairs have a result too
    told = F.when(F.col("met"), F.col("corr")).otherwise(F.lit(none))
    return every.join(F.broadcast(met), "ord", "left").select("ord", told.alias("corr"))  # a row a pair


def correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(ord, feature, corr) with the label as 0 or 1, all features in one pass."""
    y = F.col(label).cast("double")
    names = F.element_at(folds.constants(features), F.col("ord") + 1)
    return _pairwise(df, [(_d(f), y) for f in features]).select("ord", names.alias("feature"), "corr")


def importance(corrs: DataFrame, n: int = 15) -> DataFrame:
    """The n strongest features, ties in feature order, with their strength in words."""
    size = F.abs("corr")
    name = F.when(size > 0.5, "STRONG").when(size > 0.3, "MODERATE").otherwise("WEAK")
    return corrs.withColumn("importance", size).withColumn("strength", name).orderBy(F.desc("importance"), "ord").limit(n)


def best_predictors(corrs: DataFrame, above: float = 0.3) -> DataFrame:
    return corrs.where(F.abs("corr") > above)


def corr_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, corr) of all pairs, in one pass; NaN where a feature has no variance."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    told = _pairwise(df, [(_d(a), _d(b)) for a, b in pairs], float("nan"))
    a, b = (F.element_at(folds.constants(names), F.col("ord") + 1) for names in zip(*pairs, strict=True))
    both = F.when(a == b, F.array(F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b"))))
    return told.select(F.inline(both), "corr").select("a", "b", "corr")


def _counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(s, p, n): positives and negatives of each distinct score."""
    known = df.where(F.col(score).isNotNull() & ~F.isnan(_d(score)))
    return known.groupBy(_d(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))


def _between(counts: DataFrame, ts: Column) -> DataFrame:
    """(b, p, n): counts of the scores that are at or over b of the ascending thresholds."""
    at = F.size(F.filter(ts, lambda t: t <= F.col("s")))
    return counts.groupBy(at.alias("b")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def threshold_search(df: DataFrame, score: str, label: str, points: int = 20) -> DataFrame:
    """(t, separation): the point between least and largest score with the most true negatives less
    twice the false negatives, the first of equals; 0.5 for fewer than two rows."""
    counts = _counts(df, score, label)
    ends = counts.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum(F.col("p") + F.col("n")).alias("rows"))
    point = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)
    ends = ends.withColumn("ts", F.when(F.col("lo").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(points - 1)), point)))
    below = _between(counts.crossJoin(F.broadcast(ends.select("ts"))), F.col("ts"))
    met = ends.select("rows", F.posexplode("ts").alias("i", "t")).join(F.broadcast(below), F.col("b") <= F.col("i"), "left")  # points rows, points + 1 counts
    best = met.groupBy("i", "t", "rows").agg(F.coalesce(F.sum(F.col("n") - 2 * F.col("p")), F.lit(0)).alias("separation")).orderBy(F.desc("separation"), "i").limit(1)
    return best.select(F.when(F.col("rows") < 2, 0.5).otherwise(F.col("t")).alias("t"), "separation")


def threshold_metrics(df: DataFrame, score: str, label: str, points: int = 50) -> DataFrame:
    """(i, t, recall, precision, fpr, f1, utility) at points from 0 to 1, predicting s >= t."""
    ts = df.sparkSession.range(points).select(F.col("id").alias("i"), (F.col("id") / (points - 1)).alias("t"))
    counts = _between(_counts(df, score, label), F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / (points - 1)))
    hit = F.col("b") > F.col("i")
    met = ts.join(F.broadcast(counts), F.lit(True), "left").groupBy("i", "t").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in (("tp", F.when(hit, F.col("p"))), ("fp", F.when(hit, F.col("n"))), ("p", F.col("p")), ("n", F.col("n")))))  # at most points + 1 counts
    share = lambda a, b, other: F.coalesce(F.try_divide(a, b), F.lit(other))
    met = met.select("i", "t", share("tp", "p", 0.0).alias("recall"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), share("fp", "n", 0.0).alias("fpr"))
    return met.withColumns({"f1": F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), "utility": 1 - F.col("fpr")})


def best_f1(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("f1"), "i").limit(1)


def nearest(metrics: DataFrame, t: float) -> DataFrame:
    """The row whose threshold is nearest, the first of equals."""
    return metrics.orderBy(F.abs(F.col("t") - t), "t").limit(1)


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall) at each distinct score and the closing point (null, 1, 0).

    Counts run down the distinct scores. So that this isn't one task, scores are dealt into ranges
    of which a small table has the totals above each."""
    counts = _counts(df, score, label)
    buckets = 64
    ends = counts.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    placed = counts.crossJoin(F.broadcast(ends)).withColumn("b", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).otherwise(0)).drop("lo", "hi")
    above = placed.groupBy("b").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp"))
    lead = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)  # at most 65 rows
    above = above.select("b", F.coalesce(F.sum("tp").over(lead), F.lit(0)).alias("tp0"), F.coalesce(F.sum("fp").over(lead), F.lit(0)).alias("fp0"), F.sum("tp").over(W.partitionBy(F.lit(0))).alias("all_p"))
    down = W.partitionBy("b").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    run = placed.join(F.broadcast(above), "b").select("s", "all_p", (F.col("tp0") + F.sum("p").over(down)).alias("tp"), (F.col("fp0") + F.sum("n").over(down)).alias("fp"))
    points = run.select(F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("all_p")), F.lit(1.0)).alias("recall"))
    last = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(last)


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n, share of its label), all four cells."""
    counts = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))
    cells = literal.table(df.sparkSession, [(y, p) for y in (False, True) for p in (False, True)], "y boolean, pred boolean")
    full = cells.join(counts, ["y", "pred"], "left").na.fill(0, ["n"])
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy("y"))), F.lit(0.0)))


def rates_by_class(df: DataFrame, flags: Sequence[str], label: str) -> DataFrame:
    """(feature, rate_sensitive, rate_not): mean of each flag in either class, 0 for no rows."""
    mean = lambda f, y: F.coalesce(F.avg(F.when(y, F.col(f).cast("int"))), F.lit(0.0))
    y = F.col(label)
    row = df.agg(*(F.struct(F.lit(f).alias("feature"), mean(f, y).alias("rate_sensitive"), mean(f, ~y).alias("rate_not")).alias(f) for f in flags))
    return row.select(F.inline(F.array(*flags)))


def box_stats(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(y, feature, q1, median, q3, low, high): quartiles and the fences at 1.5 times their gap."""
    long = df.select(F.col(label).alias("y"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), _d(f).alias("v")) for f in features))))
    q = ordered.quantiles(long, ["y", "feature"], "v", (0.25, 0.5, 0.75))
    gap = F.col("q")[2] - F.col("q")[0]
    q = q.select("y", "feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[0] - 1.5 * gap).alias("f0"), (F.col("q")[2] + 1.5 * gap).alias("f1"))
    met = long.join(F.broadcast(q), ["y", "feature"])  # two rows a feature
    inside = F.col("v").between(F.col("f0"), F.col("f1"))
    return met.groupBy("y", "feature", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"))


def histogram(df: DataFrame, score: str, label: str, bins: int = 20) -> DataFrame:
    """(y, bin, n, density) of equal bins between each class's ends, the last one closed."""
    ends = df.groupBy(F.col(label).alias("y")).agg(F.min(_d(score)).alias("lo"), F.max(_d(score)).alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("s") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    placed = df.select(F.col(label).alias("y"), _d(score).alias("s")).join(F.broadcast(ends), "y").withColumn("bin", at.cast("int"))
    counts = placed.groupBy("y", "bin", "lo", "hi", "total").agg(F.count("*").alias("n"))
    return counts.select("y", "bin", "n", F.coalesce(F.try_divide(F.col("n"), F.col("total") * (F.col("hi") - F.col("lo")) / bins), F.lit(0.0)).alias("density"))


def scatter(df: DataFrame, id: str, features: Sequence[str], score: str, label: str) -> DataFrame:
    """(id, feature, value, score, y): the points of all scatter plots."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), _d(f).alias("value")) for f in features))
    return df.select(id, F.col(score).alias("score"), F.col(label).alias("y"), F.inline(pairs))


def running_count(df: DataFrame, flag: Column, order: Sequence[str]) -> DataFrame:
    """Adds n and n_flagged, running over the whole order, which should be total."""
    told = ordered.running(df, order, n=("sum", F.lit(1)), n_flagged=("sum", flag.cast("int")))
    return told.withColumns({"n": F.col("n").cast("long"), "n_flagged": F.col("n_flagged").cast("long")})
