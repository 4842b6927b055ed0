"""Betweenness against counting all paths; the query by hops is held against SQL with the catalogue."""

import itertools
import random

import pytest

from tesserae.operators import paths as pt


def shares(edges, directed):
    """Per node the summed shares of shortest paths between ordered pairs of others that pass it, by trying all paths."""
    length = {}
    for a, b, w in edges:
        for x, y in ((a, b),) if directed else ((a, b), (b, a)):
            length[x, y] = min(w, length.get((x, y), w))
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        walks = [(s, *mid, t) for k in range(len(nodes) - 1) for mid in itertools.permutations([n for n in nodes if n not in (s, t)], k)]
        costs = [(sum(length[p] for p in itertools.pairwise(w)), w) for w in walks if all(p in length for p in itertools.pairwise(w))]
        best = [w for c, w in costs if c == min(costs)[0]]
        for w in best:
            for n in w[1:-1]:
                out[n] += 1 / len(best)
    return out


@pytest.mark.parametrize(("directed", "weighted", "rows"), [(False, True, pt.ROWS), (True, True, 400), (True, False, pt.ROWS)])
def test_equals_counting_all_paths(spark, directed, weighted, rows):
    """Several small graphs side by side, in one batch and in several."""
    rng, edges, want = random.Random(5), [], {}
    for g in range(6):
        own = [(f"{a}{g}", f"{b}{g}", rng.randint(1, 3)) for a, b in itertools.permutations("abcdef", 2) if (directed or a < b) and rng.random() < 0.45]
        want |= shares(own if weighted else [(a, b, 1) for a, b, _ in own], directed)
        edges += own
    edges += [("a0", "a0", 5), (None, "b0", 1), edges[0][:2] + (9,)]
    want.setdefault("a0", 0.0)
    n = len(want)
    table = spark.createDataFrame(edges, "src string, tgt string, weight long")
    got = {r.node: r.betweenness for r in pt.betweenness(table, directed, weighted, rows=rows).collect()}
    assert got == {k: pytest.approx(v / ((n - 1) * (n - 2)), abs=1e-9) for k, v in want.items()}


def test_a_path_pivots_and_small_graphs(spark):
    line = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, tgt string, weight long")
    got = {r.node: r.betweenness for r in pt.betweenness(line, directed=False).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(2 / 3), "c": pytest.approx(2 / 3), "d": 0.0}
    assert {r.node: r.betweenness for r in pt.betweenness(line, False, pivots=9).collect()} == got
    assert len(pt.betweenness(line, False, pivots=2).collect()) == 4
    assert [r.node for r in pt.top_betweenness(line, False, k=2).collect()] == ["b", "c"]
    assert [tuple(r) for r in pt.betweenness(line.limit(1)).orderBy("node").collect()] == [("a", 0.0), ("b", 0.0)]
    assert pt.betweenness(line.limit(0)).collect() == []
    with pytest.raises(ValueError, match="over zero"):
        pt.betweenness(line.withColumn("weight", line.weight - 1))
