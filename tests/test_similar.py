"""Similar texts and their clusters against comparing all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import similar as si


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def edited(rng, text, n, letters="abc é漢"):
    out = list(text)
    for _ in range(n):
        at = rng.randint(0, len(out))
        if rng.random() < 0.5 and at < len(out):
            del out[at]
        else:
            out.insert(at, rng.choice(letters))
    return "".join(out)


def texts_of(seed):
    """Texts of all lengths, and copies of them about as many edits away as the limit allows."""
    rng, out = random.Random(seed), [None, "", "a", "a", "b", "ab", "😀" * 40]
    for _ in range(25):
        n = rng.choice([3, 8, 15, 30, 60, 150, 400])
        text = "".join(rng.choice("abcdefgh é漢") for _ in range(n))
        out += [text] + [edited(rng, text, rng.randint(0, max(1, n // 5))) for _ in range(rng.randint(0, 4))]
    return out


def alike(texts, least):
    first = {t: min(i for i, x in enumerate(texts) if x == t) for t in texts if t is not None}
    return {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations(first, 2) if si.ratio(a, b) >= least}, first


def grouped(pairs, first, texts):
    name = {i: i for i in first.values()}
    for _ in name:
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    own = [(i, name[first[t]]) for i, t in enumerate(texts) if t is not None]
    many = [c for _, c in own]
    return sorted((i, c) for i, c in own if many.count(c) > 1)


def test_ratio_counts_the_common_subsequence():
    rng = random.Random(3)
    assert si.common_length("abcbdab", "bdcaba") == 4 and si.ratio("abcd", "abed") == 75.0 and si.ratio("", "") == 100.0
    for _ in range(200):
        a = "".join(rng.choice("abc漢") for _ in range(rng.randint(0, 30)))
        b = edited(rng, a, rng.randint(0, 20))
        assert si.common_length(a, b) == lcs(a, b)


@pytest.mark.parametrize("least", [70.0, 80.0, 95.0, 100.0])
def test_no_pair_is_lost(spark, least):
    texts = texts_of(int(least))
    df = spark.createDataFrame(list(enumerate(texts)), "_row_idx long, text string").repartition(3)
    pairs, first = alike(texts, least)
    assert {(r.u, r.v) for r in si.similar_pairs(df, least).collect()} == pairs
    if least in (80.0, 95.0):
        assert sorted((r.row, r.cluster) for r in si.clusters(df, least).collect()) == grouped(pairs, first, texts)


def test_links_that_no_key_shows_join_groups(spark, monkeypatch):
    """Without any least-hash key all links come from the segments."""
    texts = texts_of(11)
    df = spark.createDataFrame(list(enumerate(texts)), "_row_idx long, text string")
    monkeypatch.setattr(si, "_stars", lambda texts: texts.selectExpr("k AS u", "k AS v").limit(0))
    pairs, first = alike(texts, 90.0)
    assert sorted((r.row, r.cluster) for r in si.clusters(df, 90.0).collect()) == grouped(pairs, first, texts)


def test_plan_leaves_a_segment_unspoilt():
    for least in (67, 75, 80, 90, 95, 99):
        plan = si.Plan(least)
        m = np.arange(1, 3000)
        assert (m // plan.size(m) > plan.most(m)).all()
    with pytest.raises(ValueError, match="indexed"):
        si.Plan(60)


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    assert {(r.k, r.c) for r in si.components(links).collect()} == {(i, 0) for i in range(301)} | {(1000, 1000), (1001, 1000)}


def test_empty_tables(spark):
    none = spark.createDataFrame([(1, None)], "_row_idx long, text string")
    assert si.clusters(none).collect() == [] and si.similar_pairs(none.limit(0)).collect() == []


def test_all_documents_equal_all_pairs(spark, data_dir):
    from tesserae.plans.catalog import ALIKE, QUERIES

    docs = spark.read.parquet(f"{data_dir}/documents.parquet").orderBy("doc_id").collect()
    texts, ids = [r.text for r in docs], [r.doc_id for r in docs]
    first = {t: min(i for i, x in enumerate(texts) if x == t) for t in texts if t is not None}
    pairs = {(first[a], first[b]) for a, b in itertools.combinations(first, 2) if si._similar(a, b, ALIKE)}
    want = [(ids[i], ids[c]) for i, c in grouped(pairs, first, texts)]
    assert want and sorted((r.row, r.cluster) for r in QUERIES["dup_clusters"](spark, data_dir).collect()) == want


def test_blocks_meet_and_nothing_is_shipped_by_place(spark, monkeypatch):
    """Many small blocks, of lengths across classes, lose no pair; the plan ships texts, not places of segments."""
    monkeypatch.setattr(si, "BYTES", 3_000)
    rng, texts = random.Random(5), texts_of(21)
    for n in (700, 3_000, 9_000):
        text = "".join(rng.choice(["ab ", "cde ", "f ", "gha ", "é "]) for _ in range(n // 3))
        texts += [text, edited(rng, text, n // 30), edited(rng, text, n // 30), text[: int(n * 0.93)], "".join(rng.choice(["ab ", "cde ", "f ", "gha ", "é "]) for _ in range(n // 3))]
    df = spark.createDataFrame(list(enumerate(texts)), "_row_idx long, text string").repartition(3)
    pairs, first = alike(texts, 92.0)
    assert {(r.u, r.v) for r in si.similar_pairs(df, 92.0).collect()} == pairs
    assert sorted((r.row, r.cluster) for r in si.clusters(df, 92.0).collect()) == grouped(pairs, first, texts)
    shipped = si._meetings(si._texts(df, "_row_idx", "text").withColumn("c", F.col("k")), 92.0)
    assert shipped.count() < 200 * len(texts) and "pos" not in shipped.columns


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n // 6))[:n]


def test_long_texts_of_one_vocabulary_are_told_apart_without_comparing_them(monkeypatch):
    """Texts with the same grams in another order pass the counts; only copies are looked at segment by segment."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    texts = [prose(rng, words, 14_000) for _ in range(30)]
    texts += [edited(rng, t, 350) for t in texts[:5]]
    seen = []
    near = si._near
    monkeypatch.setattr(si, "_near", lambda a, b, *more: seen.append(1) or near(a, b, *more))
    block = si._Block(list(range(35)), list(range(35)), texts)
    found, passed = set(), 0
    for i, places in si._passed(block, block, 95.0):
        passed += len(places)
        for j in si._by_zone(block, i, block, places.tolist(), 95.0):
            if si._near(block.t[i], block.t[j], 95.0, {}) and si._similar(block.t[i], block.t[j], 95.0):
                found.add(tuple(sorted((block.k[i], block.k[j]))))
    assert found == {(i, 30 + i) for i in range(5)} and passed > 300 and len(seen) < 10


def test_counts_of_grams_leave_few_texts_to_the_others():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(2_000)]
    for n in (300, 1_000, 2_500, 5_000):
        texts = [prose(rng, words, n) for _ in range(60)] + ["a" * n, "a" * (n - 1)]
        texts += [edited(rng, t, n // 25) for t in texts[:8]]
        block = si._Block(list(range(70)), list(range(70)), texts)
        passed = {tuple(sorted((block.k[i], block.k[j]))) for i, places in si._passed(block, block, 95.0) for j in places.tolist()}
        alike = {p for p in itertools.combinations(range(70), 2) if si.ratio(texts[p[0]], texts[p[1]]) >= 95.0}
        assert alike <= passed and len(passed) < len(alike) + 100


def test_reaching_a_length_equals_counting_it():
    """The bit vector of near places against the whole one, for edits that are spread, at one place, and moved blocks."""
    rng = random.Random(10)
    for n in (1, 40, 300, 2_000):
        for _ in range(25):
            a = "".join(rng.choice("abcdefgh é漢") for _ in range(n))
            at, some = rng.randrange(n), rng.randint(0, n // 7)
            for b in (edited(rng, a, some), a[some:] + a[:some], a[:at] + edited(rng, a[at : at + n // 9], some) + a[at + n // 9 :], a[:at] + "x" * some + a[at:], a[:at] + a[at + some :]):
                for least in (80.0, 95.0, 100.0):
                    assert si._similar(a, b, least) == (si.ratio(a, b) >= least)
