"""Fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.graph import components
from tesserae.llm.registry import op4_simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, ids, radius=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_whole_table_equals_brute_force(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r.doc_id for r in rows]), strict=True)}
    assert {tuple(r) for r in op4_simhash(spark, data_dir).collect()} == want


def test_odd_rows(spark):
    texts = [None, "", " \n", "One", "one", "a b", "ÀB c d e", "Àb C D E", "x y z " * 30_000, None]
    ids = [5, 3, 9, 1, 7, 2, 8, 6, 4, None]
    df = spark.createDataFrame([(i, t, "c") for i, t in zip(ids, texts, strict=True)] * 2, "doc_id long, text string, fp string")
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted([(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(fps, ids), strict=True)] * 2, key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "cap"), [(3, 32768), (3, 40), (2, 32768), (5, 32768), (5, 60)])
def test_links_lose_nothing(spark, radius, cap):
    rng = np.random.default_rng(radius)
    heart = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    near = [int(h) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, radius + 3), replace=False)) for h in rng.choice(heart, 300)]
    fps = sorted({*near, *map(int, rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)), 0, -1})
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    found = components(simhash.links(df, radius, cap)).collect()
    root = {r.node: r.root for r in found}
    got = [root.get(f, f) for f in fps]
    want = brute_components([f & (1 << 64) - 1 for f in fps], fps, radius)
    assert got == want


def test_plan_covers_the_radius():
    rng = np.random.default_rng(1)
    sample = rng.integers(-(1 << 63), 1 << 63, 2000, dtype=np.int64)
    for total in (10, 10**5, 10**8, 10**10):
        for radius in (1, 3, 6):
            parts = simhash.plan(sample, total, radius)
            # The parts cover disjoint bits and their slack rules out a pair that all parts miss.
            bits = [b for p in parts for b in p.bits]
            assert len(bits) == len(set(bits))
            assert sum(p.threshold + 1 for p in parts) == radius + 1
    assert len(simhash.plan(sample, 10**5, 3)) > len(simhash.plan(sample, 10**9, 3))


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("u"), ((F.col("id") + 1) * 7919 % n).alias("v"))
    got = components(edges).collect()
    assert len(got) == n - 1 and {r.root for r in got} == {0}


def test_deduplicate_loses_no_similar_pair(spark):
    rng = np.random.default_rng(8)
    rows, far = [], 0
    for k in range(300):
        words = [f"w{rng.integers(5000)}" for _ in range(rng.integers(40, 200))]
        cut = len(words) - int(0.17 * len(words))
        copy = words[:cut] if k % 2 else words + [f"v{rng.integers(5000)}" for _ in range(int(0.17 * len(words)))]
        a, b = " ".join(words), " ".join(copy)
        mine, theirs = set(simhash.shingles(a, 5)), set(simhash.shingles(b, 5))
        assert len(mine & theirs) >= 0.8 * len(mine | theirs)
        far += (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > simhash.RADIUS
        rows += [(2 * k, a), (2 * k + 1, b)]
    assert far > 50
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == list(range(0, 600, 2))


def test_similar_links_equal_brute_force():
    rng = np.random.default_rng(9)
    hearts = [rng.integers(-(1 << 62), 1 << 62, n) for n in (5, 9, 40, 41, 200)]
    grams = [np.unique(np.where(rng.random(len(h)) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 300, len(h)), h)) for h in (hearts[i] for i in rng.integers(0, 5, 120))]
    grams += [np.zeros(0, np.int64)] * 3
    n = len(grams)
    edges = simhash.similar_links(np.arange(n), np.zeros(n, int), grams, 0.8)
    got = simhash.roots(n, *np.array(edges).T)
    pairs = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(grams[i], grams[j])) >= 0.8 * len(np.union1d(grams[i], grams[j]))]
    assert (got == simhash.roots(n, *np.array(pairs).T)).all() and len(set(got)) > 5
