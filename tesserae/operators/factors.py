"""Topics of a corpus by non-negative factorisation of its weighted terms.

The table of (row, term, weight) is approximated by rows x topics times topics x terms, both without
negative numbers, by multiplicative updates: each round makes the terms' factors from a join of the stored
table with the rows' factors and a sum per term, and then the rows' factors likewise. Only the topics x topics
products pass the driver. The loss, the squared error over all cells, never rises.

Where a bounded vocabulary is told (``factorise_rows``), the terms' factors are sent to every task instead, and rows stay where they are:
a round is one pass over rows that hold their terms, and only sums per task and term are shuffled. The factors of a row are made
anew from its first ones in each pass, so nothing but the last ones is written.

Factors start from hashes, so reruns agree up to the order of sums. Rows and terms without weights have no
factors. Weights must not be negative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import kept

#: Keeps divisions away from zero.
TINY = 1e-12


@dataclass
class Factors:
    """rows: row, w (array); terms: term, h (array); losses: after each round."""

    rows: DataFrame
    terms: DataFrame
    losses: list[float]


def _gram(df: DataFrame, column: str, k: int) -> np.ndarray:
    """Sums of products of each two of the ``k`` numbers of an array column."""
    sums = [F.sum(F.col(column)[i] * F.col(column)[j]) for i in range(k) for j in range(i, k)]
    told, out = df.agg(*sums).first(), np.zeros((k, k))
    for value, (i, j) in zip(told, ((i, j) for i in range(k) for j in range(i, k)), strict=True):
        out[i, j] = out[j, i] = value or 0.0
    return out


def _summed(column: Column, k: int) -> list[Column]:
    return [F.sum(F.col("weight") * column[i]).alias(f"s{i}") for i in range(k)]


def _updated(old: str, gram: np.ndarray, k: int) -> Column:
    """Each number times its sum over what the product of the factors makes of it."""
    of = lambda i: sum((F.col(old)[j] * F.lit(float(gram[i, j])) for j in range(k)), F.lit(TINY))
    return F.array(*[F.col(old)[i] * F.col(f"s{i}") / of(i) for i in range(k)])


def start(key: Column, k: int, seed: int) -> Column:
    """Numbers in (0, 1] that follow from the key."""
    return F.array(*[(F.pmod(F.xxhash64(key.cast("string"), F.lit(f"{seed}:{i}")), F.lit(1_000_003)) + 1) / 1_000_003 for i in range(k)])


def factorise(weights: DataFrame, topics: int = 8, rounds: int = 10, seed: int = 42) -> Factors:
    """Factors of a table (row, term, weight)."""
    cells = kept(weights.select("row", "term", F.col("weight").cast("double").alias("weight")).where("weight > 0"), "cells")
    square = cells.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] or 0.0
    w = kept(cells.select("row").distinct().select("row", start(F.col("row"), topics, seed).alias("w")), "rows")
    h = kept(cells.select("term").distinct().select("term", start(F.col("term"), topics, seed + 1).alias("h")), "terms")
    losses = []
    for _ in range(rounds):
        sums = cells.join(w, "row").groupBy("term").agg(*_summed(F.col("w"), topics))
        h = kept(h.join(sums, "term").select("term", _updated("h", _gram(w, "w", topics), topics).alias("h")), "terms")
        over = _gram(h, "h", topics)
        sums = kept(cells.join(h, "term").groupBy("row").agg(*_summed(F.col("h"), topics)), "sums")
        w = kept(w.join(sums, "row").select("row", _updated("w", over, topics).alias("w")), "rows")
        # Of the squared error the cells need one sum: the sums per row, times the rows' factors.
        cross = w.join(sums, "row").agg(F.sum(sum((F.col("w")[i] * F.col(f"s{i}") for i in range(topics)), F.lit(0.0)))).first()[0] or 0.0
        losses.append(float(square - 2 * cross + (_gram(w, "w", topics) * over).sum()))
    return Factors(w, h, losses)


def factorise_rows(cells: DataFrame, known: DataFrame, topics: int = 8, rounds: int = 10, seed: int = 42) -> Factors:
    """Factors of rows (row, terms, tfs) of unit length, whose terms are the places of the terms of ``known`` (term, idf) in its order.

    ``known`` passes the driver and must be bounded; weights are 1 + ln tf, times idf.
    """
    spark, k = cells.sparkSession, topics
    told = known.select("term", "idf", start(F.col("term"), k, seed + 1).alias("h")).toArrow().combine_chunks()  # a bounded vocabulary
    names, idf = told.column("term"), told.column("idf").to_numpy()
    h = np.array(told.column("h").to_pylist(), float).reshape(-1, k)
    first = cells.select("row", "terms", "tfs", start(F.col("row"), k, seed).alias("w"))
    kind, done, losses = cells.schema["row"].dataType.simpleString(), [], []
    for r in range(rounds):
        sums = first.mapInArrow(_pass(spark.sparkContext.broadcast((idf, done)), k, False), "term int, " + ", ".join(f"s{i} double" for i in range(k)))
        got = sums.groupBy("term").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).toArrow()  # a row for each term of ``known``
        at, values = got.column("term").to_numpy(), np.stack([got.column(f"s{i}").to_numpy() for i in range(k)], 1)
        whole = np.zeros((len(h) + k + 2, k))
        whole[at] = values
        gram, (cross, square) = whole[len(h) : len(h) + k], whole[len(h) + k :, 0]
        if r:
            losses.append(float(square - 2 * cross + (gram * done[-1][1]).sum()))
        h = h * whole[: len(h)] / (h @ gram + TINY)
        done = [*done, (h, h.T @ h)]
    last = kept(first.mapInArrow(_pass(spark.sparkContext.broadcast((idf, done)), k, True), f"row {kind}, w array<double>, x double, q double"), "rows")
    cross, square = last.agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("q"), F.lit(0.0))).first()
    if rounds:
        losses.append(float(square - 2 * cross + (_gram(last, "w", k) * done[-1][1]).sum()))
    terms = spark.createDataFrame(pa.table({"term": names, "h": pa.array(h.tolist(), pa.list_(pa.float64()))}))
    return Factors(last.select("row", "w"), terms, losses)


def _pass(sent: Broadcast, k: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows' factors after the rounds ``sent``: themselves, or the sums of a task that the next terms' factors need.

    Sums come per term, then the products of the rows' factors, then what they make of the cells, and the cells' squares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, done = sent.value
        out = np.zeros((len(idf) + k + 2, k))
        for batch in batches:
            if not len(batch):
                continue
            n = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            at, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            begin, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            raw = (1 + np.log(tf)) * idf[at]
            weight = raw / np.sqrt(np.add.reduceat(raw * raw, begin))[row]
            w, s = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k), np.zeros((len(n), k))
            for h, gram in done:
                s = np.add.reduceat(h[at] * weight[:, None], begin, axis=0)
                w = w * s / (w @ gram + TINY)
            x, q = (w * s).sum(1), np.add.reduceat(weight * weight, begin)
            if last:
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(w.ravel())), pa.array(x), pa.array(q)], names=["row", "w", "x", "q"])
                continue
            for i in range(k):
                out[: len(idf), i] += np.bincount(at, weight * w[row, i], len(idf))
            out[len(idf) : len(idf) + k] += w.T @ w
            out[len(idf) + k :, 0] += x.sum(), q.sum()
        if not last:
            there = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *[pa.array(out[there, i]) for i in range(k)]], names=["term", *[f"s{i}" for i in range(k)]])

    return run


def topic_terms(found: Factors, k: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the strongest terms of each topic, as a share of it."""
    each = found.terms.select("term", F.posexplode("h").alias("topic", "weight"))
    shared = each.join(F.broadcast(each.groupBy("topic").agg(F.sum("weight").alias("all"))), "topic")  # one row per topic
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= k).select("topic", "rank", "term", (F.col("weight") / F.greatest("all", F.lit(TINY))).alias("weight"))


def assigned(found: Factors, scales: Sequence[float] | None = None) -> DataFrame:
    """(row, topic, share): the topic that makes most of a row, by the weight of all its terms."""
    k = len(found.terms.select("h").first()[0]) if not found.terms.isEmpty() else 0
    if not k:
        return found.rows.select("row", F.lit(0).alias("topic"), F.lit(0.0).alias("share")).limit(0)
    size = scales or found.terms.agg(*[F.sum(F.col("h")[i]) for i in range(k)]).first()
    part = F.array(*[F.col("w")[i] * F.lit(float(size[i] or 0.0)) for i in range(k)])
    made = found.rows.select("row", part.alias("p")).withColumn("best", F.array_max("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return made.select("row", (F.array_position("p", F.col("best")) - 1).cast("int").alias("topic"), (F.col("best") / F.greatest(total, F.lit(TINY))).alias("share"))
