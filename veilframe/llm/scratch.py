"""What the operators share: stored tables, batch sizes, choices by count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, remove, shuffled, stored

__all__ = ["broadcast_small", "by_rows", "frequent", "new_path", "remove", "shuffled", "small_batches", "stored"]

SMALL_ROWS = 500_000  # rows of a few numbers each, some 20 MB, are broadcast
FEW_ROWS = 20_000  # some 2 MB: as many as a query may broadcast a dozen times


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows than Spark's default, which holds some 30 MB of texts several
    times over in each task; a session's own choice stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def broadcast_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """For broadcast where it has at most `rows` rows, of a few numbers each; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_rows(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A side of a join: broadcast where it has at most `rows` rows, of a few numbers each, else sorted and
    shuffled. The planner doesn't guess."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def frequent(counted: DataFrame, bound: int, n: str = "n", fill: str | None = None) -> DataFrame:
    """The rows with the largest counts `n`, at most `bound` of them: all whose count reaches the
    least one that keeps the bound. It is found from the number of rows of each count (large counts
    to three digits), so no task sorts the table. Rows of the first count beyond the bound stay out;
    with the name of a key column in `fill`, about as many of them as there is room for, chosen by
    its hash, come in."""
    c = F.col(n)
    digits = F.pow(F.lit(10.0), F.floor(F.log10(c.cast("double"))) - 2).cast("long")
    rounded = F.when(c < 1000, c).otherwise(F.floor(c / digits) * digits).cast("long")
    left, least, share = 0, 1 << 62, None
    for r in counted.groupBy(rounded.alias("n")).count().orderBy(F.desc("n")).collect():
        if left + r["count"] > bound:
            share = (r["n"], 0.98 * (bound - left) / r["count"])
            break
        left += r["count"]
        least = r["n"]
    some = c >= least
    if fill and share:
        some |= (rounded == share[0]) & (F.pmod(F.xxhash64(fill), F.lit(1 << 20)) < int(share[1] * (1 << 20)))
    return counted.where(some)
