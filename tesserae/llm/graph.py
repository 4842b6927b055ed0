"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v.

    Large star: every node hangs its larger neighbours on its least neighbour (or itself). Small
    star: every node hangs its smaller neighbours, and itself, on the least of them. Both join the
    edges with one least neighbour per node, so no neighbour list is ever gathered.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """For edges (u, v): each node that is not the least of its component, with that least (root).

    Every round is written to the shared folder, so lineage stays short. It ends when a round
    changes nothing; ``most`` rounds are far beyond the O(log² n) that the method needs, and more
    raise an error instead of returning part of the result.
    """
    spark = edges.sparkSession
    tidy = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = stored(tidy, "edges"), None
    for _ in range(most):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, old = mark, now
        now = stored(_star(_star(now, large=True), large=False), "edges")
        dropped(spark, old)
    raise RuntimeError("components did not settle")
