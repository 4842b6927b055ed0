"""The round trip against the source rows, and the windows' own promises."""

import hashlib
import time
from collections import defaultdict

import duckdb
import pytest

from tesserae.llm.chat_windows import CLOSE, MIDDLE, OPEN, read_back, windows
from tesserae.llm.registry import ORACLE, op5_chat_windows

SAID = "\\### Assistant: </turn> ok"


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_whole_table(spark, data_dir="/root/testdata/sf0.01"):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = op5_chat_windows(spark, data_dir)
    assert got(out) == brute([*rows, (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)])
    assert out.where("n_windows > 1").count() > 0


ODD = [
    (1, 0, "system", "be ### kind"), *[(1, i, ("user", "assistant")[i % 2], f"turn {i} <:> \\ " + "w " * (40 * i)) for i in range(1, 12)],
    (2, 0, "system", "alone"), (3, None, None, None), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, 1, "assistant", "x"),
    (4, 0, "assistant", "</turn>\n### user<:> a</turn>\n\\"), (4, 1, "a<:> b", "\\<#\\"), (5, 0, "user", "long " * 20_000), (5, 1, "assistant", "ééé" * 9_000), (6, 3, "assistant", ""),
]


@pytest.mark.parametrize(("budget", "history"), [(1024, 192), (60, 20), (400, 100), (1, 0)])
def test_odd_rows_and_window_promises(spark, budget, history):
    df = spark.createDataFrame([(*r, "x") for r in ODD], "conv_id long, turn long, role string, text string, formatted string")
    made = windows(df, budget, history)
    assert got(read_back(made)) == brute(ODD)
    for r in made.collect():
        turns = r.formatted.split(CLOSE)[:-1]
        assert all(t.startswith(OPEN) and t.count(MIDDLE) == 1 for t in turns)
        assert r.over_budget == (r.tokens > budget)
        if r.over_budget:  # only a single long turn, beside what is repeated, may pass the budget
            assert len(turns) - r.repeated <= 2
        if r.conv_id == 1:
            assert turns[0].startswith("### system<:> ")
        for a, b in r.loss:
            assert r.formatted[:a].endswith("### assistant<:> ") and r.formatted[b:].startswith(CLOSE)
    assert read_back(windows(df.limit(0))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{d}/conversations.parquet'")
    want = con.sql(ORACLE["op5_chat_windows"])
    got = op5_chat_windows(spark, d).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
    assert {t for _, t in got.dtypes} == {"bigint", "string"} and {str(t) for t in want.types} == {"BIGINT", "VARCHAR"}


def test_a_conversation_of_fifty_thousand_turns(spark):
    """15 MB of text in one conversation, in the test session's 3 GB; windows hold all turns and little else."""
    from pyspark.sql import functions as F

    turns = spark.range(50_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat_ws(" ", F.lit("turn"), F.col("id").cast("string"), F.repeat(F.lit("word <#> "), 33)).alias("text"),
    )
    started = time.time()
    r = read_back(windows(turns)).collect()[0]
    assert got(read_back(windows(turns))) == brute([tuple(x) for x in turns.collect()])
    assert r.n_turns == 50_000 and r.formatted_chars < 25_000_000 and r.n_windows > 4_000
    assert time.time() - started < 120


def test_the_query_starts_no_python_worker(spark, data_dir):
    from tesserae.llm.registry import QUERIES

    plan = QUERIES["op5_chat_windows"](spark, data_dir)._jdf.queryExecution()
    assert "Python" not in plan.toRdd().toDebugString() and "Python" not in plan.toString()
