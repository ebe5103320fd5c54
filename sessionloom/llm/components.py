"""Connected components of a link table, as Spark joins.

Alternating large-star and small-star steps: each round joins nothing with itself; it groups
links by node and re-points neighbours at the smallest node seen. The rounds needed grow with
the logarithm of the longest chain. Every round is written to the shared folder.

A node with very many links is split: the smallest neighbour of each node is a plain
aggregate with map-side combining, and re-pointing is a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b, distinct."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # each neighbour greater than the node points at the smallest one around
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link."""
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now, was = staged(pairs, "links"), None
    while True:
        now = staged(_star(_star(now, True), False), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        was = mark
