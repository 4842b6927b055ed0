"""The mix against its SQL and against its promises."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.llm import source_mix
from tesserae.llm.registry import ORACLE, op2_source_mix


def filled(sizes):
    """Targets by sharing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = 1.5 * sum(sizes.values()), set(order)
    while left > 1e-6 and free:
        total = sum(w[s] for s in free)
        more = {s: left * w[s] / total for s in free}
        left = 0.0
        for s, x in more.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_keeps_its_promises(spark, sf):
    d = f"/root/testdata/{sf}"
    got = sorted(tuple(r) for r in op2_source_mix(spark, d).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as from '{d}/documents.parquet'")
    want = sorted(con.sql(ORACLE["op2_source_mix"]).fetchall())
    assert [(*g[:4], round(g[4], 6), *g[5:]) for g in got] == [(*w[:4], round(w[4], 6), *w[5:]) for w in want]
    sizes, taken, target = {}, {}, {}
    for _, s, size, total, t, copies, took in got:
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + size, taken.get(s, 0) + took, t
        assert copies in (0, 1, 2) and took == copies * size
    for s, t in filled(sizes).items():
        assert math.isclose(target[s], t, rel_tol=1e-6)
        assert abs(taken[s] - t) <= max(g[2] for g in got if g[1] == s) / 2


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 4}" if i % 5 else None, i) for i in range(400)] + [(7, None, None, 0), (7, "a b", "s1", 0), (7, "a b", "s1", 0), (None, "x " * 30_000, "s2", 1), (900, "", "empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = source_mix.mix(df).collect()
    assert len(got) == len(rows)
    assert {r.source: r.target for r in got if r.source == "empty"} == {"empty": 0.0}
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        if s != "s2":  # one text makes up nearly all of s2
            assert abs(sum(r.taken for r in own) - own[0].target) <= 40
    assert source_mix.mix(df.limit(0)).count() == 0
    again = source_mix.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_own_weights_move_the_choice(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (1 + F.col("id") % 2 * 3).alias("own_weight"))
    got = source_mix.mix(df, weights=(1, 1, 1), share=0.5, weight="own_weight").withColumn("heavy", F.col("doc_id") % 2).groupBy("heavy").agg(F.sum("taken").alias("n")).collect()
    n = {r.heavy: r.n for r in got}
    assert abs(n[0] + n[1] - 6000) < 10 and 3.5 < n[1] / n[0] < 4.5


def test_chosen_documents_come_with_their_texts(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 4}" if i % 5 else None, i) for i in range(400)] + [(7, None, None, 0)] + [(7, "a b", "s1", 0)] * 3 + [(None, "x " * 30, "s2", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    plan = source_mix.mix(df, carry=("text",)).collect()
    want = {}
    for r in plan:
        copies, taken = want.get((r.doc_id, r.source, r.text), (0, 0))
        want[r.doc_id, r.source, r.text] = (copies + r.copies, taken + r.taken)
    got = source_mix.chosen(df).collect()
    assert {(r.doc_id, r.source, r.text): (r.copies, r.taken) for r in got} == {k: v for k, v in want.items() if v[1]}
    assert len(got) == sum(v[1] > 0 for v in want.values()) < len(rows) and got[0].asDict().keys() == {"doc_id", "text", "source", "copies", "taken"}
    assert source_mix.chosen(df.limit(0)).count() == 0
