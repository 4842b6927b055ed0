"""The tag fold against a plain replay of the log, and the registered streams against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.streaming import tags as tg


def replayed(events):
    """(row, coder, cat, seq) that stand, by the batch rules, with the batches undone by their last undo or redo left out."""
    last = {}
    for seq, batch, action, *_ in sorted(events):
        if action in ("undo", "redo"):
            last[batch] = action
    live = [e for e in events if e[2] in ("tag", "untag") and last.get(e[1]) != "undo"]
    state = {}
    for seq, _, action, row, coder, cat, group, _ in sorted(live):
        state[row, coder, cat] = (seq, action, group)
    rival = {}
    for (row, coder, cat), (seq, action, group) in state.items():
        if action == "tag":
            key = (row, coder, ("g", group) if group else ("c", cat))
            rival[key] = max(rival.get(key, (0, "")), (seq, cat))
    return sorted((row, coder, cat, seq) for (row, coder, _), (seq, cat) in rival.items())


def log_of(seed, n=120):
    rng, out, batches = random.Random(seed), [], {}
    for seq in range(1, n + 1):
        if rng.random() < 0.2 and batches:
            batch = rng.choice(list(batches))
            action = rng.choice(["undo", "redo"])
            out += [(seq * 10 + i, batch, action, row, coder, cat, group, seq) for i, (row, coder, cat, group) in enumerate(batches[batch])]
        else:
            batch, own = seq, [(rng.randint(0, 3), rng.choice("xy"), cat, "g" if cat in "ab" else None) for cat in rng.sample("abcd", 2)]
            batches[batch] = own
            action = rng.choice(["tag", "tag", "untag"])
            out += [(seq * 10 + i, batch, action, row, coder, cat, group, seq) for i, (row, coder, cat, group) in enumerate(own)]
    return out


def frame(spark, events):
    df = spark.createDataFrame(events, "seq long, batch long, action string, _row_idx long, coder string, cat_id string, `group` string, minute int")
    return df.select("*", F.lit("cb").alias("codebook_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("minute"))).alias("ts"))


@pytest.fixture
def rocks(spark):
    from tesserae.plans.streams import ROCKS

    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.unset(name)


def test_fold_with_undo_and_redo_equals_a_replay(spark, rocks):
    from tesserae.plans.streams import fed

    events = log_of(1)
    got = tg.latest(fed(frame(spark, events + events[:5]), "ts", tg.tag_changes))
    assert sorted((r._row_idx, r.coder, r.cat_id, r.seq) for r in got.collect()) == replayed(events)


def test_timers_move_old_events_into_the_base(spark, rocks):
    """With a horizon of minutes the log is compacted on the way; an undo beyond it comes too late."""
    from tesserae.plans.streams import fed

    events = [e for e in log_of(2, 60) if e[2] in ("tag", "untag")]
    late = [(10**6, events[0][1], "undo", *events[0][3:7], 5000)]
    work = lambda s: tg.tag_changes(s, horizon="10 minutes")
    got = tg.latest(fed(frame(spark, events + late), "ts", work, slices=4))
    assert sorted((r._row_idx, r.coder, r.cat_id, r.seq) for r in got.collect()) == replayed(events)


def test_the_fold_ignores_the_order_of_events():
    events = [(1, 1, "tag", "a", "g", 0), (2, 2, "tag", "b", "g", 0), (3, 1, "undo", "a", "g", 0), (4, 4, "untag", "b", "g", 0), (5, 1, "redo", "a", "g", 0)]
    for seed in range(10):
        random.Random(seed).shuffle(events)
        assert tg.standing(tg.settled({}, events)) == [("a", 1)]
    assert tg.standing(tg.settled({"a": (9, "untag", None)}, [(1, 1, "tag", "a", None, 0)])) == []


@pytest.mark.parametrize("name", ["tag_state_stream", "tag_undo_stream", "bucket_counts_stream", "first_seen_stream"])
def test_registered_streams_equal_sql(spark, data_dir, name):
    from tesserae.plans.streams import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data_dir}/events.parquet'")
    got = QUERIES[name](spark, data_dir)
    columns = ", ".join(got.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall())


def test_a_call_reads_and_writes_state_once_and_a_key_has_one_timer():
    class Handle:
        def __init__(self):
            self.held, self.calls, self.timers = None, [], []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

        def registerTimer(self, at):
            self.timers.append(at)

    from types import SimpleNamespace as Event

    handle, fold = Handle(), tg.TagFold(100)
    fold.init(handle)
    key = ("cb", 1, "x")
    at = lambda seq, action, when: Event(seq=seq, batch=seq, action=action, cat_id="a", grp=None, at=when)
    assert [tuple(r) for r in fold.handleInputRows(key, iter([at(1, "tag", 10)]), None)] == [(*key, "a", 1, 1)]
    assert [tuple(r) for r in fold.handleInputRows(key, iter([at(2, "untag", 50)]), None)] == [(*key, None, None, 2)]
    assert handle.calls == ["get", "update"] * 2 and handle.timers == [110]
    assert list(fold.handleExpiredTimer(key, None, Event(getExpiryTimeInMs=lambda: 110))) == [] and handle.timers == [110, 150]
    undo = Event(seq=3, batch=2, action="undo", cat_id="a", grp=None, at=60)
    assert [tuple(r) for r in fold.handleInputRows(key, iter([undo]), None)] == [(*key, "a", 1, 3)]
