"""Factorisation against the same updates in numpy."""

import random

import numpy as np
import pytest

from tesserae.operators import factors as fa
from tesserae.operators import search as se


def updates(v, w, h, rounds):
    losses = []
    for _ in range(rounds):
        h = h * (w.T @ v) / (w.T @ w @ h + fa.TINY)
        w = w * (v @ h.T) / (w @ h @ h.T + fa.TINY)
        losses.append(((v - w @ h) ** 2).sum())
    return w, h, losses


def cells_of(spark, rows, terms, seed):
    rng = random.Random(seed)
    cells = [(r, f"t{t}", round(rng.random(), 3)) for r in range(rows) for t in range(terms) if rng.random() < (0.8 if r % 2 == t % 2 else 0.1)]
    return cells, spark.createDataFrame(cells, "row long, term string, weight double")


def test_updates_equal_numpy(spark):
    cells, df = cells_of(spark, 14, 9, 3)
    rows, terms = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    v = np.zeros((len(rows), len(terms)))
    for r, t, x in cells:
        v[rows.index(r), terms.index(t)] = x
    begin = lambda c, seed: {r[0]: r[1] for r in df.select(c).distinct().select(c, fa.start(df[c], 2, seed)).collect()}
    w, h = begin("row", 42), begin("term", 43)
    w, h, losses = updates(v, np.array([w[r] for r in rows]), np.array([h[t] for t in terms]).T, 4)
    found = fa.factorise(df.repartition(3), topics=2, rounds=4)
    assert found.losses == pytest.approx(losses, rel=1e-6) and all(b <= a + 1e-9 for a, b in zip(found.losses, found.losses[1:], strict=False))
    got = {r.row: r.w for r in found.rows.collect()}
    assert np.allclose(np.array([got[r] for r in rows]), w)
    got = {r.term: r.h for r in found.terms.collect()}
    assert np.allclose(np.array([got[t] for t in terms]).T, h)
    share = w * h.sum(1)
    best = {r.row: (r.topic, r.share) for r in fa.assigned(found).collect()}
    assert all(best[r] == (int(share[i].argmax()), pytest.approx(share[i].max() / share[i].sum())) for i, r in enumerate(rows))
    shown = fa.topic_terms(found, 3).collect()
    assert len(shown) == 6 and all(r.term == terms[int(np.argsort(-h[r.topic], kind="stable")[r["rank"] - 1])] for r in shown)


def test_empty_table(spark):
    found = fa.factorise(spark.createDataFrame([(1, "a", 0.0)], "row long, term string, weight double"), 2, 1)
    assert fa.assigned(found).collect() == [] and fa.topic_terms(found).collect() == [] and found.losses == [0.0]


def test_rows_with_their_terms_give_the_factors_of_the_table(spark):
    """The bounded vocabulary, the rows' places in it and the updates, against ``search.weights`` and ``factorise``."""
    rng = random.Random(4)
    rows = [(i, None if i % 9 == 0 else " ".join(f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randint(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "_row_idx long, text string").repartition(3)
    weights = se.weights(df, min_df=2, features=50).selectExpr("_row_idx AS row", "term", "weight")
    want = fa.factorise(weights, topics=3, rounds=3)
    known = spark.createDataFrame(se.vocabulary(df, min_df=2, features=50).collect(), "term string, idf double").orderBy("term")
    assert [r.term for r in known.collect()] == sorted(r.term for r in want.terms.collect()) and known.count() == 50
    sent = spark.sparkContext.broadcast(known.select("term").toArrow().column("term").combine_chunks())
    got = fa.factorise_rows(se.numbered_rows(df, sent), known, topics=3, rounds=3)
    assert got.losses == pytest.approx(want.losses, rel=1e-9)
    for one, other, key, value in ((got.rows, want.rows, "row", "w"), (got.terms, want.terms, "term", "h")):
        a, b = ({r[key]: r[value] for r in x.collect()} for x in (one, other))
        assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x], rel=1e-9) for x in a)


def test_rows_without_terms(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "_row_idx long, text string")
    known = se.vocabulary(df)
    sent = spark.sparkContext.broadcast(known.select("term").toArrow().column("term").combine_chunks())
    found = fa.factorise_rows(se.numbered_rows(df, sent), known, 2, 1)
    assert fa.assigned(found).collect() == [] and fa.topic_terms(found).collect() == [] and found.losses == [0.0]
