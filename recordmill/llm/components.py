"""Connected components of a graph held as a table of links, by alternating large-star and small-star steps.

Every step is an aggregation by node (partial sums before the shuffle) and an equality join, so that a node with very many
links is split by Spark's skew handling; nothing is gathered on the driver but a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Table (node, component) for every node that has a link; component is the smallest node reachable.

    links: two long columns u, v; self-links, repeated and reversed links are allowed, null ends are ignored.
    """
    now = cut(links.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    mark = None
    for _ in range(rounds):
        before, now = now, cut(_small_star(_large_star(now)))
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
