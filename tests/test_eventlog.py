"""Appending, compacting and replaying a log, with writers at the same time."""

import random
import threading

from tesserae.eventlog import EventLog, last_of


def batch(spark, rows):
    return spark.createDataFrame(rows, "seq long, key string, action string")


def folded(rows):
    out = {}
    for seq, key, action in sorted(rows):
        out[key] = (seq, action)
    return sorted((seq, key, action) for key, (seq, action) in out.items())


def test_replay_equals_the_fold_of_all_events(spark, tmp_path):
    rng, log, sent = random.Random(1), EventLog(spark, f"file://{tmp_path}/log", last_of("key")), []
    assert log.replay() is None and log.tail() is None and not log.compact()
    seqs = rng.sample(range(1000), 60)
    for i in range(6):
        rows = [(s, rng.choice("abcdefg"), rng.choice(["tag", "untag"])) for s in seqs[i * 10 : i * 10 + 10]]  # late events too
        assert log.append(batch(spark, rows)) == i + 1
        sent += rows
        if i in (1, 3):
            assert log.compact() and log.tail() is None
        assert sorted(tuple(r) for r in log.replay().collect()) == folded(sent)
    assert log.tail().count() == 20


def test_writers_at_once_lose_no_batch(spark, tmp_path):
    """Three writers append while a fourth compacts."""
    root, sent = f"file://{tmp_path}/log", [(i, f"k{i % 7}", f"{i}") for i in range(90)]
    logs = [EventLog(spark, root, last_of("key")) for _ in range(4)]
    logs[3].append(batch(spark, [(-1, "first", "x")]))
    work = [threading.Thread(target=lambda n=n: [logs[n].append(batch(spark, sent[n * 30 + i : n * 30 + i + 10])) for i in (0, 10, 20)]) for n in range(3)]
    for w in work:
        w.start()
    logs[3].compact()
    for w in work:
        w.join()
    number, state = logs[0].manifest.last()
    assert state["batches"] == 10 and number == 11
    want = folded([*sent, (-1, "first", "x")])
    assert sorted(tuple(r) for r in logs[0].replay().collect()) == want
    logs[1].compact()
    assert sorted(tuple(r) for r in logs[2].replay().collect()) == want and logs[2].tail() is None
