"""Overlaps against brute force, and the promise of the seeds."""

import itertools
import random
import time

import numpy as np
import pytest

from tesserae.llm import decontaminate as d
from tesserae.llm.registry import op9_decontaminate


@pytest.mark.parametrize(("window", "changed"), [(20, 4), (16, 3), (15, 3), (10, 2), (5, 0)])
def test_seeds_meet_every_window(window, changed):
    places = [sum(1 << (p + i) for i, c in enumerate(m) if c == "1") for m in d.MASKS for p in range(window - len(m) + 1)]
    for bad in itertools.combinations(range(window), changed):
        hit = sum(1 << b for b in bad)
        assert any(p & hit == 0 for p in places)


def brute(docs, items):
    out = set()
    for i, t in items:
        mine = d.tokens(t)
        w = min(d.WINDOW, len(mine))
        agree = d.AGREE if len(mine) >= d.LEAST else 1.0
        for k, text in docs:
            theirs = d.tokens(text)
            for shift in range(-len(mine) + 1, len(theirs)):
                equal = [0 <= j + shift < len(theirs) and theirs[j + shift] == x for j, x in enumerate(mine)]
                if any(sum(equal[a : a + w]) >= agree * w for a in range(len(mine) - w + 1) if w):
                    out.add((k, i))
                    break
    return out


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 4, 5, 6, 7, 15, 25, 40])))) for i in range(14)] + [(50, None), (51, "")]
    docs = [(90, None), (91, ""), (92, items[3][1]), (92, items[3][1])]
    for k in range(60):
        words = [word() for _ in range(rng.randint(0, 60))]
        if k % 2:
            part = items[rng.randrange(14)][1].split()
            part = part[rng.randint(0, len(part) // 3) :]
            words[rng.randint(0, len(words)) : 0] = [w if rng.random() < 0.85 else "zz" for w in part]
        docs.append((k, " ".join(words).upper()))
    df = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    got = d.overlaps(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10
    assert {(r.doc_id, r.item_id) for r in d.overlaps(df, bench, block=500).collect()} == want
    kept = {k for k, _ in docs} - {k for k, _ in want}
    assert {r.doc_id for r in d.clean(df, bench).collect()} == kept == {r.doc_id for r in d.clean(df, bench, block=500).collect()}
    assert d.overlaps(df.limit(0), bench).count() == d.overlaps(df, bench.limit(0)).count() == 0


def test_whole_table_holds_all_quoted_items(spark, data_dir="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()
    told = [(r.doc_id, f" {' '.join(d.tokens(r.text))} ") for r in docs]
    want = {(k, i.item_id) for i in items for k, t in told if f" {' '.join(d.tokens(i.text))} " in t}
    got = {(r.doc_id, r.item_id) for r in op9_decontaminate(spark, data_dir).collect()}
    assert want <= got and len(got) == len(want) > 0


@pytest.mark.parametrize(("size", "changed"), [(5, 1), (6, 1), (7, 1)])
def test_short_items_with_a_substitution(size, changed):
    words = [f"w{i}" for i in range(size)]
    index = d.Index([(1, " ".join(words)), (2, " ".join(f"v{i}" for i in range(30)))])
    for bad in itertools.combinations(range(size), changed):
        text = " ".join("zz" if i in bad else w for i, w in enumerate(words))
        assert index.find([f"a b {text} c"]) == [(0, 0, size - changed, size, 2)], bad


def test_shortest_items_and_scripts_without_spaces():
    index = d.Index([(1, "Paris"), (2, "the grey owl"), (3, "今天天气很好我们去公园散步"), (4, "!!")])
    texts = ["in paris", "the grey fox", "a the  GREY owl.", "说今天天气很好我们去公园走步。", "今天天气", None, "!!"]
    assert [(t, index.items[i]) for t, i, *_ in index.find(texts)] == [(0, 1), (2, 2), (3, 3)]


def test_a_phrase_of_many_items_and_a_very_long_text():
    shared_ = " ".join(f"s{i}" for i in range(12))
    items = [(k, f"{shared_} " + " ".join(f"i{k}x{j}" for j in range(20))) for k in range(3000)]
    index = d.Index(items)
    long = " ".join(f"w{i}" for i in range(400_000))
    started = time.process_time()
    assert index.find([shared_] * 5) == []
    text = f"{long} {items[7][1]} {long} {shared_}"
    assert index.find([text]) == [(0, 7, 32, 32, 400_000)]
    assert time.process_time() - started < 20


def test_blocks_of_pairs_change_nothing(monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([2, 6, 18, 30])))) for k in range(20)]
    texts = [" ".join(rng.choice("abcd") for _ in range(80)) for _ in range(6)]
    whole = d.Index(items).find(texts)
    monkeypatch.setattr(d, "PAIRS", 7)
    assert d.Index(items).find(texts) == whole != []


def test_whole_table_equals_brute_force(spark, data_dir="/root/testdata/sf0.001"):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    told = [(k, np.array([hash(w) for w in d.tokens(t)], np.int64)) for k, t in docs]
    want = set()
    for i, t in items:
        mine = np.array([hash(w) for w in d.tokens(t)], np.int64)
        w = min(d.WINDOW, len(mine))
        for k, theirs in told:
            padded = np.concatenate([np.zeros(len(mine), np.int64), theirs, np.zeros(len(mine), np.int64)])
            equal = (np.lib.stride_tricks.sliding_window_view(padded, len(mine)) == mine).cumsum(axis=1)
            equal = np.pad(equal, ((0, 0), (1, 0)))
            if (equal[:, w:] - equal[:, :-w] >= d.AGREE * w).any():
                want.add((k, i))
    assert {(r.doc_id, r.item_id) for r in op9_decontaminate(spark, data_dir).collect()} == want
