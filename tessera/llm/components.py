"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import forget, settle


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each vertex move to the least vertex around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each vertex, and itself, move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    kept = moved.select(F.col("u"), F.col("m").alias("v")).unionByName(moved.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return kept.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root for each vertex of edges(u long, v long) that is not its own root.

    The driver sees a count and a checksum of each round, never an edge.
    """
    now = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        after = settle(_small(_large(now)))
        forget(now)
        now = after
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now.select("u", F.col("v").alias("root"))
        mark = tuple(row)
