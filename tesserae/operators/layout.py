"""A neighbour graph of vectors and a two-dimensional layout in which every vector has a place.

``neighbours`` finds the ``k`` most similar vectors of each. Up to ``EXACT`` vectors, blocks of ``SIDE`` meet pair by pair
and the result is exact: a vector is sent once to each block, which at these sizes is far less than the rounds below ship,
and no task holds more than two blocks. Beyond, it finds about the most similar. Random hyperplanes deal vectors to blocks, in
several ways, and a hash in one more; a block that is too large is divided by hash, so no task grows with a hot spot. Within a block all
similarities are computed. Then, as in NN-descent, the neighbours of a vector (either way) meet in one block, which
finds neighbours of neighbours; rounds of this mend what the first blocks cut apart.

``layout`` places a bounded number of landmarks, chosen by hash of their keys, by attraction along their own
neighbour graph and repulsion between all, starting from principal components. All other vectors start between their
nearest landmarks, and are then drawn to their neighbours in the graph. The landmarks, at most ``LANDMARKS`` vectors,
are the only ones that the driver and every task hold.

Similarity is the cosine. Null vectors are left out. A vector of zeros is as similar to all others: 0. Keys are
whole numbers, each once. Ties go to the smaller key. Fewer vectors than ``k`` have all others as neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import kept

#: Vectors of a block at most on average, ways of dealing, candidates kept for each neighbour on the way, and landmarks.
BLOCK, WAYS, WIDER, LANDMARKS = 500, 4, 2, 1_000
#: Vectors up to which all blocks meet, and vectors of such a block on average.
EXACT, SIDE = 1_000_000, 20_000
EDGES = "row long, other long, similarity double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; a row of zeros stays."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _stored(vectors: DataFrame, column: str) -> Column:
    """The vectors as floats where they are, else as doubles: nothing is shipped wider than it is stored."""
    return F.col(column) if vectors.schema[column].dataType.simpleString() == "array<float>" else F.col(column).cast("array<double>")


def _best(keys: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a block the ``k`` most similar others."""
    order = np.argsort(keys)
    keys, m = keys[order], m[order]
    near = m @ m.T
    np.fill_diagonal(near, -np.inf)
    take = min(k, len(keys) - 1)
    at = np.argsort(-near, axis=1, kind="stable")[:, :take]
    return np.repeat(keys, take), keys[at].reshape(-1), np.take_along_axis(near, at, 1).reshape(-1)


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    whole = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
    return pa.table({"row": pa.array(whole[0].astype(np.int64)), "other": pa.array(whole[1].astype(np.int64)), "similarity": pa.array(whole[2].astype(np.float64))})


def _kept_best(edges: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("similarity"), "other"))
    once = edges.groupBy("row", "other").agg(F.max("similarity").alias("similarity"))
    return once.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _met(mine: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of one block the ``k`` most similar of another, or of itself; both are in order of their keys."""
    found = []
    for cut in range(0, len(mine[0]), 500):
        keys, m = mine[0][cut : cut + 500], mine[1][cut : cut + 500]
        near = m @ others[1].T
        near[keys[:, None] == others[0]] = -np.inf
        take = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - take, axis=1)[:, near.shape[1] - take, None]
        i, j = np.nonzero((near >= least) & (near > -np.inf))
        order = np.lexsort((j, -near[i, j], i))
        i, j = i[order], j[order]
        held = np.arange(len(i)) - np.searchsorted(i, np.arange(len(keys)))[i] < k
        i, j = i[held], j[held]
        found.append((keys[i], others[0][j], near[i, j].astype(np.float64)))
    return tuple(np.concatenate([f[x] for f in found]) for x in range(3))


def _all_blocks(slim: DataFrame, n: int, k: int) -> DataFrame:
    """(row, other, similarity): the ``k`` nearest of every vector, exactly; two blocks meet in one task."""
    blocks = max(1, -(-n // SIDE), min(8, n // 2_000))
    own = slim.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    to = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    sent = own.select("row", "v", "b", to).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "row", "v")

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        b, keys, m = t.column("b").to_numpy(), t.column("row").to_numpy(), _matrix(t.column("v"))
        low, high = b == b.min(), b == b.max()
        one, two = (keys[low], m[low]), (keys[high], m[high])
        if t.column("i")[0] == t.column("j")[0]:
            return _edges([_met(one, one, k)])
        return _edges([_met(one, two, k), _met(two, one, k)] if b.min() < b.max() else [])

    found = sent.groupBy("i", "j").applyInArrow(meet, EDGES)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("similarity"), "other"))
    return kept(found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r"), "edges")


def neighbours(vectors: DataFrame, k: int = 10, rounds: int = 8, key: str = "vec_id", column: str = "embedding", seed: int = 42) -> DataFrame:
    """(row, other, similarity): about the ``k`` nearest of every vector; rounds end when one changes a thousandth of the edges at most."""
    slim = kept(vectors.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("row"), _stored(vectors, column).alias("v")), "vectors")
    n = slim.count()
    if n < 2:
        return slim.select("row", F.col("row").alias("other"), F.lit(0.0).alias("similarity")).limit(0)
    if n <= EXACT:
        return _all_blocks(slim, n, k)
    bits = max(0, int(np.ceil(np.log2(n / BLOCK))))
    size, wide = len(slim.first()["v"]), WIDER * k

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((WAYS, bits, size))
        for batch in batches:
            m = _matrix(batch.column(1))
            for way in range(WAYS):
                code = ((m @ planes[way].T > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(m), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), way)), pa.array(code.astype(np.int64)), *batch.columns], names=["way", "code", "row", "v"])

    kind = slim.schema["v"].dataType.simpleString()
    codes = slim.mapInArrow(dealt, f"way long, code long, row long, v {kind}")
    # One more way is by hash alone: a vector that stands apart from all meets others too.
    codes = codes.where(F.col("way") < (WAYS if bits else 1)).unionByName(
        slim.select(F.lit(WAYS).cast("long").alias("way"), F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << bits)).alias("code"), "row", "v").where(F.lit(bits > 0))
    )
    sizes = codes.groupBy("way", "code").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    blocks = codes.join(sizes, ["way", "code"]).withColumn("part", F.pmod(F.xxhash64("row", "way"), F.col("parts")))
    first = blocks.groupBy("way", "code", "part").applyInArrow(lambda t: _edges([_best(t.column("row").to_numpy(), _matrix(t.column("v")), wide)]), EDGES)
    edges = kept(_kept_best(first, wide), "edges")
    for i in range(rounds if bits else 0):
        met = edges.select(F.col("row").alias("at"), F.col("other").alias("row")).union(edges.select(F.col("other").alias("at"), "row"))
        met = met.union(slim.select(F.col("row").alias("at"), "row")).distinct()
        many = met.groupBy("at").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
        shared = met.join(many, "at").withColumn("part", F.pmod(F.xxhash64("row", F.lit(i)), F.col("parts"))).join(slim, "row")
        groups = max(1, n * 3 * wide // 50_000)

        def local(t: pa.Table) -> pa.Table:
            at, part, keys, m = t.column("at").to_numpy(), t.column("part").to_numpy(), t.column("row").to_numpy(), _matrix(t.column("v"))
            order = np.lexsort((part, at))
            cuts = np.flatnonzero((np.diff(at[order]) != 0) | (np.diff(part[order]) != 0)) + 1
            return _edges([_best(keys[g], m[g], wide) for g in np.split(order, cuts) if len(g) > 1])

        found = shared.select("at", "part", "row", "v", F.pmod(F.xxhash64("at"), F.lit(groups)).alias("g")).groupBy("g").applyInArrow(local, EDGES)
        new = kept(_kept_best(edges.union(found), wide), "edges")
        changed = new.join(edges, ["row", "other"], "left_anti").count()
        edges = new
        if changed <= n * wide // 1000:
            break
    return _kept_best(edges, k)


def _landmarks(m: np.ndarray, k: int, rounds: int = 150) -> np.ndarray:
    """Places of landmarks: drawn along their neighbour graph, pushed from one another."""
    if len(m) < 3:
        return np.stack([np.arange(len(m), dtype=float), np.zeros(len(m))], 1)
    centred = m - m.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    axes = u[:, :2] * s[:2]
    sign = np.sign(axes[np.abs(axes).argmax(0), [0, 1]])  # a decomposition leaves signs open
    place = axes * np.where(sign == 0, 1, sign)
    place = place / max(1e-12, np.abs(place).max()) * 10
    row, other, near = _best(np.arange(len(m)), m, k)
    pull = np.maximum(near, 0) / k
    for i in range(rounds):
        step = np.zeros_like(place)
        gap = place[other] - place[row]
        np.add.at(step, row, gap * pull[:, None])
        np.add.at(step, other, -gap * pull[:, None])
        apart = place[:, None] - place[None]
        far = (apart**2).sum(2) + 0.1
        step += (apart / (far**1.5)[..., None]).sum(1) * (20 / len(m))
        length = np.linalg.norm(step, axis=1, keepdims=True)
        place = place + step / np.maximum(1, length) * (1 - i / rounds) * 0.5
    return place


def layout(vectors: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", rounds: int = 3, edges: DataFrame | None = None) -> DataFrame:
    """(key, x, y) of every vector."""
    edges = neighbours(vectors, k, key=key, column=column) if edges is None else edges
    slim = vectors.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("row"), F.col(column).cast("array<double>").alias("v"))
    chosen = slim.orderBy(F.xxhash64("row"), "row").limit(LANDMARKS).toArrow()
    if not chosen.num_rows:
        return slim.select(F.col("row").alias(key), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    marks, held = chosen.column("row").to_numpy(), _matrix(chosen.column("v"))
    sent = vectors.sparkSession.sparkContext.broadcast((marks, held, _landmarks(held, k)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, m, place = sent.value
        for batch in batches:
            near = _matrix(batch.column(1)) @ m.T
            at = np.argsort(-near, axis=1, kind="stable")[:, :3]
            share = np.maximum(np.take_along_axis(near, at, 1), 1e-9) ** 4
            here = (place[at] * share[..., None]).sum(1) / share.sum(1, keepdims=True)
            fixed = np.isin(batch.column(0).to_numpy(), keys)
            where = {int(r): p for r, p in zip(keys, place, strict=True)}
            here[fixed] = [where[int(r)] for r in batch.column(0).to_numpy()[fixed]] if fixed.any() else here[fixed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(here[:, 0]), pa.array(here[:, 1]), pa.array(fixed)], names=["row", "x", "y", "fixed"])

    placed = kept(slim.mapInArrow(begin, "row long, x double, y double, fixed boolean"), "placed")
    share = F.greatest("similarity", F.lit(1e-9))
    for _ in range(rounds):
        seen = edges.join(placed.select(F.col("row").alias("other"), "x", "y"), "other")
        mean = seen.groupBy("row").agg(*[(F.sum(F.col(c) * share) / F.sum(share)).alias(f"m{c}") for c in "xy"])
        moved = placed.join(mean, "row", "left")
        to = lambda c: F.when(F.col("fixed") | F.col(f"m{c}").isNull(), F.col(c)).otherwise((F.col(c) + F.col(f"m{c}")) / 2).alias(c)
        placed = kept(moved.select("row", to("x"), to("y"), "fixed"), "placed")
    return placed.select(F.col("row").alias(key), "x", "y")


def recall(edges: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (row, other) that the graph has, over the rows of ``exact``."""
    met = exact.select("row", "other").join(edges.select("row", "other", F.lit(1).alias("hit")), ["row", "other"], "left")
    return met.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
