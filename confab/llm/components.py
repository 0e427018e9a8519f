"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _low(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v): each with m, the least of u and its v. The least is found with map-side aggregation, so a node
    with very many neighbours doesn't gather them in one task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for every node of edges (a, b), both of one integer type, not null.

    Edges stay distributed and are checkpointed after each round; rounds end once a round changes nothing. Repeated
    edges and loops do no harm; no edges give no rows. It raises if the bound on rounds is met (the number needed grows
    as the logarithm of the nodes)."""
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark, rows = None, now.count()
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _low(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _low(large)
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # a round leaves no more edges than there were, and one for each node
        now = durable(after, 2 * rows)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rows = mark[0]
        if mark == was or not rows:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
