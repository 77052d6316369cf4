"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def contracted(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """After some rounds: links with the components of edges, nearer to stars; and (node, component), where equal names are surely
    connected and different ones may be."""
    now = edges.where("u <> v").distinct()
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)).where("u <> v").distinct(), "links")
    return now, now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v: long, in any order): the smallest node that it reaches.

    A round shuffles the links three times; rounds grow with the logarithm of the longest path. What
    goes to the driver is a count and a sum a round."""
    now = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct()
    before = None
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)).where("u <> v").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            # every node now links straight to the smallest of its component
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        before = state
    raise RuntimeError("components did not settle")
