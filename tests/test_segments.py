"""A segmented index against the search without an index, whatever was added when."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tesserae.manifest import Manifest
from tesserae.operators import search as se
from tesserae.operators import segments as sg


def texts_of(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["the"] * 900
    rows = [(i, rng.choice([None, "", "é"]) if i % 40 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "_row_idx long, text string")


def scores(df):
    return [(r[0], round(r[1], 9)) for r in df.collect()]


def test_index_in_parts_equals_the_search_of_all(spark, tmp_path):
    df, path = texts_of(spark, 400), f"file://{tmp_path}/index"
    for low, high in ((0, 150), (150, 170), (170, 400)):
        sg.add(df.where(F.col("_row_idx").between(low, high - 1)), path)
    searcher = sg.Searcher(spark, path)
    assert searcher.state["n"] == 400 and len(searcher.state["segments"]) == 3 and all(0 < s["ratio"] <= 1 for s in searcher.state["segments"])
    for query, k in (("w1 w2 the", 7), ("w3 w4 w3", 1), ("nothing here", 3)):
        assert scores(searcher.search(query, k)) == scores(se.search(df, query, k)), query
    assert searcher.read == {} or searcher.read["scored"] <= searcher.read["blocks"]
    sg.compact(spark, path)
    again = sg.Searcher(spark, path)
    assert len(again.state["segments"]) == 1
    assert scores(again.search("w1 w2 the", 7)) == scores(se.search(df, "w1 w2 the", 7))


def test_blocks_below_the_threshold_are_not_read(spark, tmp_path, monkeypatch):
    """One row of the rare term scores far above the rows of a frequent one."""
    rows = [(i, f"common filler{i % 50} padding{i % 30}") for i in range(1200)] + [(5000, "needle common"), (5001, "needle")]
    df = spark.createDataFrame(rows, "_row_idx long, text string")
    sg.add(df, f"file://{tmp_path}/index")
    searcher = sg.Searcher(spark, f"file://{tmp_path}/index")
    found = scores(searcher.search("needle filler3", 1))
    assert found == scores(se.search(df, "needle filler3", 1))
    assert searcher.read["scored"] < searcher.read["blocks"] and searcher.read["lengths"] < 30


def test_a_term_that_leaves_the_vocabulary_switches_skipping_off(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    a = spark.createDataFrame([(i, f"{'rise' if i < 2 else 'x1'} y{i % 3} z") for i in range(20)], "_row_idx long, text string")
    b = spark.createDataFrame([(100 + i, "rise rise") for i in range(400)], "_row_idx long, text string")
    sg.add(a, path)
    sg.add(b, path)
    searcher = sg.Searcher(spark, path)
    assert searcher.state["segments"][0]["ratio"] == 0.0
    assert scores(searcher.search("y1 x1", 5)) == scores(se.search(a.union(b), "y1 x1", 5))


def test_writers_lose_nothing(spark, tmp_path):
    """Another writer commits between the read and the commit of each of ours."""
    path = f"file://{tmp_path}/index"
    df = texts_of(spark, 120)
    sg.add(df.where("_row_idx < 40"), path)
    commit = Manifest.commit
    stolen = []

    def late(self, after, state):
        if not stolen:
            stolen.append(True)
            sg.add(df.where("_row_idx between 40 and 79"), path)
        return commit(self, after, state)

    Manifest.commit = late
    try:
        sg.add(df.where("_row_idx >= 80"), path)
    finally:
        Manifest.commit = commit
    searcher = sg.Searcher(spark, path)
    assert searcher.state["n"] == 120 and len(searcher.state["segments"]) == 3
    assert scores(searcher.search("w1 w2", 9)) == scores(se.search(df, "w1 w2", 9))


def test_states_are_never_overwritten(spark, tmp_path):
    manifest = Manifest(spark, f"file://{tmp_path}/table")
    assert manifest.last() == (0, {})
    assert manifest.commit(0, {"a": 1}) and not manifest.commit(0, {"a": 2}) and manifest.last() == (1, {"a": 1})
    assert manifest.change(lambda s: s | {"b": "é"}) == {"a": 1, "b": "é"} and manifest.last()[0] == 2


def test_a_term_is_stored_once_a_block_with_the_totals_of_all(spark, tmp_path):
    """Lists and totals are what plain counts make; several buckets in a task, and a segment that lacks terms of the one before."""
    df, path = texts_of(spark, 200, 4), f"file://{tmp_path}/index"
    sg.add(df.where("_row_idx % 2 = 0"), path)
    sg.add(df.where("_row_idx % 2 = 1"), path)
    state = Manifest(spark, path).last()[1]
    counted = {(r._row_idx, r.term): r.tf for r in se.counted_terms(df, "_row_idx", "text").collect()}
    df_of = Counter(t for _, t in counted)
    assert {r.term: r.df for r in sg._totals(spark, state["totals"]).collect()} == df_of
    got = {}
    for i, s in enumerate(state["segments"]):
        lists = sg._postings(spark, s["path"]).collect()
        mine = [r for r in lists if r.block is not None]
        assert len(mine) == len({(r.term, r.block) for r in mine}) and all(r.top == max(r.tfs) and len(r.rows) == len(r.tfs) for r in mine)
        assert sum(r["head"] for r in lists) == len({r.term for r in lists}) and all(not r.rows and r.df for r in lists if r.block is None)
        assert i or all(r.block is not None for r in lists)
        got |= {(row, r.term): tf for r in mine for row, tf in zip(r.rows, r.tfs, strict=True)}
        assert spark.read.parquet(f"{s['path']}/lengths").count() == len({row for r in mine for row in r.rows})
    assert got == counted
