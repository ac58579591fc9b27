"""Connected components by alternating star contraction, on joins and minima only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """node, root (the smallest node reachable) for each node of links (a, b); a node without links is not listed.

    Each round connects every larger neighbour of a node to its smallest one (large star), then every smaller
    neighbour and the node itself to the smallest one (small star), and writes the edges to the shared folder.
    It ends when the edges no longer change, in some log n rounds; each is then a node with its root. Hubs are safe: minima are
    combined before they are shuffled, and the joins are ones whose skewed partitions Spark splits.
    """
    up = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    edges, before = ws.save(up(links).distinct(), "edges0"), None
    for k in count(1):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = up(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = ws.save(large.distinct(), f"large{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = ws.save(up(small).distinct(), f"edges{k}")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ws.drop(f"large{k}", f"edges{k - 1}")
        edges = after
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
