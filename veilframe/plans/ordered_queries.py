"""Queries on order statistics of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from .explicit_queries import read


def quantiles_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of prices by flag, by counting and refining: no group of lines is small enough to sort."""
    lines = read(spark, sf_dir, "lineitem")
    q = ordered.quantiles(lines, ["l_returnflag"], "l_extendedprice", (0.01, 0.25, 0.5, 0.75, 0.99), small=500)
    return q.select("l_returnflag", *(F.round(F.get("q", k), 4).alias(n) for k, n in enumerate(("p01", "q1", "median", "q3", "p99"))))


def pareto_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no earlier one exceeds in price."""
    orders = read(spark, sf_dir, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01")))
    return ordered.unbeaten(orders.select("o_orderkey", "day", "o_totalprice"), "day", "o_totalprice").select("o_orderkey", F.col("day").cast("long").alias("day"), F.round("o_totalprice", 4).alias("o_totalprice"))


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was ordered up to each order, and the largest order so far."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    told = ordered.running(orders, ["o_orderdate", "o_orderkey"], total=("sum", F.round(F.col("o_totalprice") * 100)), most=("max", F.col("o_totalprice")))
    return told.select("o_orderkey", F.round(F.col("total") / 100, 2).alias("total"), F.round("most", 4).alias("most"))


REGISTRY = {
    "quantiles_selected": (
        quantiles_selected,
        "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS {n}" for q, n in ((0.01, "p01"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.99, "p99"))) + " FROM lineitem GROUP BY 1",
    ),
    "pareto_orders": (
        pareto_orders,
        "WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, o_totalprice FROM orders), d AS (SELECT day, max(o_totalprice) AS m FROM o GROUP BY 1), f AS (SELECT day, m FROM (SELECT day, m, max(m) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d) WHERE b IS NULL OR m > b) SELECT o_orderkey, day, round(o_totalprice, 4) AS o_totalprice FROM o JOIN f USING (day) WHERE o_totalprice = m",
    ),
    "running_totals": (
        running_totals,
        "SELECT o_orderkey, round(sum(round(o_totalprice * 100)) OVER w / 100, 2) AS total, round(max(o_totalprice) OVER w, 4) AS most FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)",
    ),
}
