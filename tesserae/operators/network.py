"""Interaction and co-mention graphs and their degrees, and lists of clusters.

Betweenness is in ``paths``, similar texts and their clusters in ``similar``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interactions(df: DataFrame, source: str = "author_handle", target: str = "in_reply_to") -> DataFrame:
    """(src, tgt, weight) of replies; blanks and replies to oneself are left out."""
    name = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    edges = df.select(name(source).alias("src"), name(target).alias("tgt")).where("src <> '' AND tgt <> '' AND src <> tgt")
    return edges.groupBy("src", "tgt").agg(F.count("*").alias("weight"))


def comentions(df: DataFrame, items: str = "mentions", least: int = 2) -> DataFrame:
    """(src, tgt, weight) of names that a row mentions together, src before tgt.

    The pairs are made within a row, whose list is short; no rows meet before the count.
    """
    names = F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    pairs = F.flatten(F.transform("n", lambda a, i: F.transform(F.slice("n", i + 2, F.greatest(F.size("n") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("src"), b.alias("tgt")))))
    each = df.select(names.alias("n")).where(F.size("n") > 1).select(F.explode(pairs).alias("p"))
    return each.groupBy("p.src", "p.tgt").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): summed weights of the edges at a node, either way."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"))


def cluster_list(named: DataFrame, df: DataFrame, most: int = 50, samples: int = 5, chars: int = 300, key: str = "_row_idx", text: str = "text") -> DataFrame:
    """(cluster, size, rows, texts): the ``most`` largest clusters with their first ``samples`` rows and the start of their texts."""
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(most)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("row"))
    shown = named.join(F.broadcast(sizes), "cluster").withColumn("rank", rank).where(F.col("rank") <= samples)  # 50 clusters
    met = df.select(F.col(key).alias("row"), F.substring(text, 1, chars).alias("start")).join(F.broadcast(shown), "row")  # 250 rows
    listed = met.groupBy("cluster", "size").agg(F.array_sort(F.collect_list(F.struct("row", "start"))).alias("s"))
    return listed.select("cluster", "size", F.array_join(F.transform("s", lambda x: x["row"].cast("string")), ",").alias("rows"), F.col("s.start").alias("texts"))
