"""Connected components of an edge table, by rounds of joins that never gather a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, stored

ROUNDS = 60
HUB = 1000  # edges of a node that is a hub, at least
MAX_HUBS = 100_000  # hubs, some 4 MB, are broadcast


def _least(edges: DataFrame, by: str, value: str, hub: int) -> DataFrame:
    """Adds `least`, the least `value` among the edges of each `by`. Nodes of more than `hub` edges
    get it by a broadcast, so no task has all the edges of one of them; `hub` bounds their number."""
    told = edges.groupBy(by).agg(F.min(value).alias("least"), F.count("*").alias("_degree"))
    hubs = F.broadcast(told.where(F.col("_degree") > hub).select(by, F.col("least").alias("_hub")))
    marked = edges.join(hubs, by, "left")
    few = marked.where("_hub is null").drop("_hub").join(told.where(F.col("_degree") <= hub).select(by, "least"), by)
    return few.unionByName(marked.where("_hub is not null").withColumnRenamed("_hub", "least"))


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Each round every node passes the least node it knows to its larger neighbours and hangs its
    larger neighbours on that least node (alternating large and small stars), which needs a
    logarithmic number of rounds. The number of edges never grows; each round is written out, so
    a lost executor costs one round, and the table of the round before goes. A hub's edges are
    never brought together: the least node around it is an aggregate, combined before the shuffle,
    and comes back by a broadcast of the hubs. Edges with a null end are left out.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    last = None
    for _ in range(ROUNDS):
        count = edges.count() if last is None else last[0]
        most = max(hub, 2 * count // MAX_HUBS)
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select("lo", "hi"))
        # large star: each larger neighbour m of n goes to the least node around n
        around = _least(both, "n", "m", most)
        large = around.where("m > n").select(F.col("m").alias("hi"), F.least("n", "least").alias("lo")).distinct()
        # small star: each node and its smaller neighbours go to the least of them
        small = _least(large, "hi", "lo", most)
        small = small.select(F.when(F.col("lo") > F.col("least"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("least").alias("lo"))
        small = stored(small.where("hi > lo").distinct(), "edges")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        remove(edges)
        edges = small
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo")).distinct()
