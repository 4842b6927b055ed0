"""Neighbour graph against all similarities, and a place for every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import layout as lo
from tesserae.operators import search as se


def test_graph_recall_and_places_of_all_embeddings(spark, data_dir, monkeypatch):
    """Blocks far smaller than the table, so that most neighbours are found across blocks."""
    monkeypatch.setattr(lo, "BLOCK", 60)
    vectors = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    edges = lo.neighbours(vectors, 10)
    exact = se.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).select(F.col("query").alias("row"), F.col("row").alias("other"))
    assert lo.recall(edges, exact) >= 0.9
    assert np.isfinite(lo.layout(vectors, edges=edges).toPandas()[["x", "y"]].to_numpy()).all()


def test_groups_of_vectors_stay_together(spark, monkeypatch):
    """Labels of the driver's embeddings do not follow the vectors, so groups are made here; most are no landmarks."""
    monkeypatch.setattr(lo, "LANDMARKS", 60)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 16)) * 4
    labels = np.arange(300) % 6
    rows = [(i, (centre[c] + rng.standard_normal(16)).tolist()) for i, c in enumerate(labels.tolist())]
    placed = lo.layout(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().sort_values("vec_id")
    spot = placed[["x", "y"]].to_numpy()
    near = ((spot[:, None] - spot[None]) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    assert len(placed) == 300 and (labels[near.argmin(1)] == labels).mean() > 0.9


def test_hot_spots_nulls_zeros_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(lo, "BLOCK", 20)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(150)] + [(200 + i, [float(i), 1.0, 2.0]) for i in range(40)] + [(500, None), (501, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    edges = lo.neighbours(df, 5)
    assert edges.where("row = other").count() == 0 and edges.groupBy("row").count().where("count > 5").count() == 0
    assert {r.row for r in edges.collect()} == {r[0] for r in rows if r[1] is not None}
    assert lo.layout(df, 5, edges=edges).count() == len(rows) - 1
    one = df.where("vec_id = 3")
    assert lo.neighbours(one).count() == 0 and lo.layout(one).count() == 1 and lo.layout(df.limit(0)).count() == 0
    few = {(r.row, r.other) for r in lo.neighbours(df.where("vec_id between 200 and 203"), 9).collect()}
    assert few == {(a, b) for a in range(200, 204) for b in range(200, 204) if a != b}


def test_registered_layout(spark, data_dir):
    from tesserae.plans.catalog import QUERIES

    assert QUERIES["embedding_layout"](spark, data_dir).count() == spark.read.parquet(f"{data_dir}/embeddings.parquet").count()
    assert QUERIES["embedding_graph_recall"](spark, data_dir).first().recall == pytest.approx(1, abs=0.1)


def test_nearest_equals_all_similarities_with_ties_nulls_and_zeros(spark):
    """Copies tie exactly and go by key, rows without a similarity come last, and no expression over all pairs is left in the plan."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = df.where("vec_id % 20 IN (0, 1, 3)")
    for most in (4, 8_000):
        found = se.nearest(df, queries, 70, most=most)
        assert "Join" not in found._jdf.queryExecution().toString()
        mine = queries.selectExpr("vec_id AS query", "embedding AS q")
        all_pairs = df.crossJoin(mine).where("vec_id <> query").select("query", F.col("vec_id").alias("row"), se.cosine(F.col("embedding"), F.col("q")).alias("s"))
        want = {}
        for r in sorted(all_pairs.collect(), key=lambda r: (r.query, r.s is None, -(r.s or 0.0), r.row)):
            want.setdefault(r.query, []).append((r.row, r.s))
        assert [(r.query, r.row, r.similarity) for r in found.orderBy("query", "rank").collect()] == [(q, *x) for q in sorted(want) for x in want[q][:70]]


def test_blocks_that_all_meet_are_exact_and_descent_still_works(spark, data_dir, monkeypatch):
    """Copies and ties go by key; descent, which larger tables take, is held against the exact graph."""
    rng = np.random.default_rng(2)
    rows = [(i * 3, rng.standard_normal(8).tolist()) for i in range(150)] + [(1000 + i, [1.0] * 8) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(lo, "SIDE", 40)
    found = {(r.row, r.other) for r in lo.neighbours(df, 7).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    keys = np.array([i for i, _ in rows])
    near = np.round(m @ m.T, 12)
    np.fill_diagonal(near, -np.inf)
    far = {(int(keys[i]), int(keys[j])): near[i, j] for i in range(len(keys)) for j in range(len(keys))}
    least = {int(keys[i]): np.sort(near[i])[-7] for i in range(len(keys))}
    assert len(found) == 7 * len(rows) and all(far[p] >= least[p[0]] for p in found)
    vectors = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    exact = lo.neighbours(vectors, 10).select("row", "other")
    monkeypatch.setattr(lo, "EXACT", 0)
    monkeypatch.setattr(lo, "BLOCK", 60)
    descent = lo.neighbours(vectors, 10)
    assert 0.9 <= lo.recall(descent, exact) <= 1
