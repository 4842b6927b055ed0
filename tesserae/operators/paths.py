"""Betweenness by shortest paths from many sources at once, in DataFrame rounds.

A batch of sources is walked together; a row of state is (source, node). Every round is a written table:

1. distances: what got closer in the last round relaxes its edges, until nothing does;
2. the edges on shortest paths from each source, those whose ends differ by just their length;
3. counts of shortest paths, hop by hop outward;
4. for each node the sum of 1 / paths(end) over all ways on from it, hop by hop back. Times the paths
   to the node and less one, this is the share of all shortest paths from the source that pass it.

There is no limit on nodes: batches are as large as ``rows`` rows of state allow. A hub's rows meet its
many edges in a join that Spark splits when it is skewed, and all sums combine before they are dealt out.

Edges are rows of src, tgt and weight; of parallel edges the shortest counts, edges from a node to itself
and rows with a null end are left out. A path is as long as its weights together, so weights must be over
zero. The score of a node is summed over all ordered pairs of other nodes and divided by the number of such
pairs. Graphs of two nodes or fewer score zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import kept

#: Rows of state (source, node) of a batch.
ROWS = 50_000_000


def _rounds(first: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``first`` and all that ``step`` makes of it, round after round, as one table."""
    made, now = [first], first
    while True:
        now = kept(step(now), name)
        if now.isEmpty():
            return reduce(DataFrame.union, made)
        made.append(now)


def distances(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, v, d): how far every node that a source reaches is. ``sources``: s; ``edges``: a, b, w."""
    start = kept(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d")), "distances")
    made, now = [start], start
    while True:
        known = reduce(DataFrame.union, made).groupBy("s", "v").agg(F.min("d").alias("old"))
        reached = now.join(edges, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        closer = reached.join(known, ["s", "v"], "left").where("old IS NULL OR d < old").select("s", "v", "d")
        now = kept(closer, "distances")
        if now.isEmpty():
            return known.withColumnRenamed("old", "d")
        made.append(now)


def _shares(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, share): what the paths from these sources add to each node."""
    far = kept(distances(sources, edges), "far")
    ends = far.select("s", F.col("v").alias("b"), F.col("d").alias("after"))
    on = far.join(edges, F.col("v") == F.col("a")).withColumn("d", F.col("d") + F.col("w")).join(ends, ["s", "b"]).where("d = after")
    dag = kept(on.select("s", "a", "b"), "shortest")

    def outward(now: DataFrame) -> DataFrame:
        return now.join(dag, (now.s == dag.s) & (now.v == dag.a)).groupBy(now.s, F.col("b").alias("v")).agg(F.sum("x").alias("x"))

    def back(now: DataFrame) -> DataFrame:
        return now.join(dag, (now.s == dag.s) & (now.v == dag.b)).groupBy(now.s, F.col("a").alias("v")).agg(F.sum("x").alias("x"))

    begin = kept(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("x")), "paths")
    paths = kept(_rounds(begin, outward, "paths").groupBy("s", "v").agg(F.sum("x").alias("paths")), "paths")
    ways = _rounds(kept(paths.select("s", "v", (1 / F.col("paths")).alias("x")), "ways"), back, "ways").groupBy("s", "v").agg(F.sum("x").alias("x"))
    met = paths.join(ways, ["s", "v"]).where("s <> v")
    return met.groupBy("v").agg(F.sum(F.col("paths") * F.col("x") - 1).alias("share"))


def betweenness(edges: DataFrame, directed: bool = True, weighted: bool = True, pivots: int | None = None, seed: int = 42, rows: int = ROWS) -> DataFrame:
    """(node, betweenness) of all nodes, from all sources, or estimated from ``pivots`` of them by a seeded order."""
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    each = edges.select("src", "tgt", weight.alias("w")).where("src IS NOT NULL AND tgt IS NOT NULL")
    if not directed:
        each = each.union(each.select("tgt", "src", "w"))
    each = kept(each.groupBy("src", "tgt").agg(F.min("w").alias("w")), "edges")
    if not each.where("w IS NULL OR w <= 0").isEmpty():
        raise ValueError("weights must be over zero")
    names = each.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
    nodes = kept(names.withColumn("id", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    if n < 3:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    by = lambda name, id_: nodes.select(F.col("node").alias(name), F.col("id").alias(id_))
    slim = kept(each.where("src <> tgt").join(by("src", "a"), "src").join(by("tgt", "b"), "tgt").select("a", "b", "w"), "edges")
    chosen = nodes if pivots is None or pivots >= n else nodes.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string")))).limit(pivots)
    chosen = kept(chosen.select(F.col("id").alias("s")), "sources")
    count = chosen.count()
    batches = max(1, -(-count * n // rows))
    parts = [kept(_shares(chosen.where(F.pmod(F.xxhash64("s"), F.lit(batches)) == i), slim), "shares") for i in range(batches)]
    score = reduce(DataFrame.union, parts).groupBy("v").agg(F.sum("share").alias("share"))
    scaled = F.coalesce("share", F.lit(0.0)) * (n / count / ((n - 1) * (n - 2)))
    return nodes.join(score, nodes.id == score.v, "left").select("node", scaled.alias("betweenness"))


def top_betweenness(edges: DataFrame, directed: bool = True, weighted: bool = True, k: int = 20, pivots: int | None = None) -> DataFrame:
    """The ``k`` nodes of highest betweenness; ties by name."""
    return betweenness(edges, directed, weighted, pivots).orderBy(F.desc("betweenness"), "node").limit(k)
