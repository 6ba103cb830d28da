"""Connected components of an edge table by randomised contraction, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import pinned, settled


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges(a, b)``.

    In each round a node points to that of its neighbours or itself which has most neighbours, ties
    in a fresh random order, and the edges are rewritten between the nodes pointed to.  Stars
    vanish in one round, and of other graphs a constant share of the nodes.  Nothing but the question whether edges are left goes to the driver.
    """
    edges = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    labels, round_ = None, 0
    rest = edges
    while rest.head(1):
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("degree"))
        self_ = degree.select(F.col("b").alias("a"), "b", "degree")
        seen = both.join(degree, "b").select("a", "b", "degree").union(self_)
        to = pinned(seen.groupBy("a").agg(F.max(F.struct("degree", F.xxhash64("b", F.lit(round_)), "b"))["b"].alias("to")))
        labels = to.select(F.col("a").alias("node"), F.col("to").alias("component")) if labels is None else labels.join(to, labels["component"] == to["a"], "left").select("node", F.coalesce("to", "component").alias("component"))
        x, y = to.select(F.col("a"), F.col("to").alias("p")), to.select(F.col("a").alias("b"), F.col("to").alias("q"))
        rest = settled(rest.join(x, "a").join(y, "b").select(F.col("p").alias("a"), F.col("q").alias("b")).filter("a <> b").distinct())
        round_ += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = pinned(labels)
    smallest = labels.groupBy("component").agg(F.min("node").alias("smallest"))
    return labels.join(smallest, "component").select("node", F.col("smallest").alias("component"))
