"""Connected components by alternating large and small stars, one DataFrame job a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour."""
    e = _both(edges)
    least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return e.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it can reach), for every node of the edges (u, v).

    Rounds run until the edges are stars that don't change, about the square of the
    logarithm of the largest component at most. Each round is written to the shared
    checkpoint folder. Minima come from partial aggregation, so a hub is no hot key.
    """
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    now = durable(edges.filter("u <> v").select("u", "v").distinct())
    seen = now.agg(*mark).first()
    while seen[0]:
        now = durable(_small_star(_large_star(now)))
        after = now.agg(*mark).first()
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
