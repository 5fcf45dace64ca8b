"""Connected components of a graph given as a table of edges, by alternating
large-star and small-star steps.  No step gathers a node's neighbours: each is
a minimum per node and a join back, which adaptive execution splits at hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest around it."""
    around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    joined = around.filter("v > u").join(least, "u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and itself, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root: for every node that has an edge and isn't its component's
    smallest, that smallest node.  ``edges``: columns a, b (longs, either order;
    loops and repetitions do no harm; without edges the result is empty)."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        now = stored(_small_star(_large_star(now)), "stars")
        # done when every node points to one other, and that one to none
        nodes = now.groupBy("u").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("v"))
        onward = nodes.select(F.col("u").alias("v"), F.lit(1).alias("hop"))
        if not nodes.join(onward, "v", "left").filter("k > 1 OR hop IS NOT NULL").limit(1).count():
            return now.select("u", F.col("v").alias("root"))
