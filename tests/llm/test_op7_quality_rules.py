"""Counts against brute force, the estimator against numpy, and verdicts against labels."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import quality_rules as q
from tesserae.llm.registry import op7_quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute(text):
    words = WORDS(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


@pytest.fixture(scope="module")
def judged(spark):
    return op7_quality_rules(spark, "/root/testdata/sf0.01").cache()


def test_counts_of_the_whole_table(spark, judged):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = judged.collect()
    assert len(got) == len(docs)
    for r in got:
        assert counts(r) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_verdicts_follow_the_labels(spark, judged):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = judged.where(~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_odd_rows(spark):
    texts = [None, "", " ", "a b c d e a b c d e f g h i j k", "x " * 30_000, "\n\n", "é ü # <a>\n\x0b# <a>\n# <a>\r", "one two three four five six seven eight nine ten eleven"]
    rows = [(i, t, None if i % 2 else "en", "s", "z") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words string")
    got = q.judge(df).collect()
    assert sorted((r.doc_id, *counts(r)) for r in got) == sorted((r[0], *brute(r[1])) for r in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few rows for any estimate
    assert q.judge(df.limit(0)).count() == 0


def plain_mcd(x, share, starts=40):
    """The least determinant over the ``share`` of rows, by concentration steps from many random starts."""
    rng, best = np.random.default_rng(1), (np.inf, None, None)
    for k in range(starts):
        some = x[rng.choice(len(x), min(len(x), 12), replace=False)] if k else x
        mean, cov = some.mean(axis=0), np.cov(some.T, bias=True) + 1e-6 * np.eye(3)
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            order = np.argsort(d, kind="stable")
            weight = np.zeros(len(x))
            weight[order] = np.clip(share * len(x) - np.arange(len(x)), 0, 1)
            mean = weight @ x / weight.sum()
            cov = (x - mean).T @ ((x - mean) * weight[:, None]) / weight.sum()
        if np.linalg.det(cov) < best[0]:
            best = (np.linalg.det(cov), mean, cov)
    return best


def test_kept_follows_a_plain_search_for_the_determinant(spark, judged):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in judged.collect()}
    rows, x = [], []
    for i, r in docs.items():
        n, chars, *_, failed = brute(r.text)
        if not failed:
            marks = sum(unicodedata.category(c)[0] not in "LN" and c not in " \t\n\x0b\x0c\r" for c in r.text)
            rows.append((i, r.lang, r.source))
            x.append([np.log(n), np.log((chars + 100) / (n + 20)), np.log((marks + 3) / (chars + 100))])
    x, langs = np.array(x), [lang for _, lang, _ in rows]
    own = Counter((lang, source) for _, lang, source in rows)
    assert max(own.values()) < q.LEAST  # so languages, or all rows, are the groups of this table
    near = 0
    for lang in set(langs):
        mine = np.array([v == lang for v in langs])
        base = x[mine] if mine.sum() >= q.LEAST else x
        _, mean, cov = plain_mcd(base, q.SHARE)
        off = x[mine] - mean
        want = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov * q.consistency(q.SHARE)), off)
        for (i, *_), d in zip([r for r, m in zip(rows, mine, strict=True) if m], want, strict=True):
            assert abs(got[i].distance - d) < 0.3 * d + 0.5, (i, got[i].distance, d)
            assert got[i].kept == (d <= q.CUTOFF) or abs(d - q.CUTOFF) < 0.25 * q.CUTOFF
            assert not got[i].degenerate
            near += 1
    assert near == len(rows) > 500


def test_estimator_withstands_a_third_of_outliers(spark):
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([5, 5, 1], [[1, 0.3, 0], [0.3, 0.5, 0.1], [0, 0.1, 0.4]], 3000)
    bad = rng.multivariate_normal([9, 12, 5], np.eye(3) * 0.1, 700)
    df = spark.createDataFrame([("g", *map(float, r)) for r in np.vstack([good, bad])], "g string, x1 double, x2 double, x3 double").repartition(3)
    r = q.estimates(df).first()
    assert np.allclose([r.m1, r.m2, r.m3], [5, 5, 1], atol=0.1)
    det, mean, cov = plain_mcd(np.vstack([good, bad]), q.SHARE, 10)
    scale = q.consistency(q.SHARE)
    told = np.array([[r.c11, r.c12, r.c13], [r.c12, r.c22, r.c23], [r.c13, r.c23, r.c33]]) / scale
    assert np.allclose(told, cov, atol=0.02) and np.linalg.det(told) < det * 1.02
    placed = df.crossJoin(q.factored(q.estimates(df)).drop("g"))
    d = placed.select((F.col("x2") > 9).alias("bad"), q.distance().alias("d")).toPandas()
    assert (d.d[~d.bad] > 30.66).mean() < 0.01 and (d.d[d.bad] > 30.66).all()


def test_degenerate_groups_are_marked(spark):
    rng = np.random.default_rng(3)
    rows = [("flat", float(v), 1.0, 2.0) for v in rng.normal(size=400)] + [("line", float(v), float(2 * v), float(w)) for v, w in rng.normal(size=(400, 2))]
    rows += [("round", *map(float, v)) for v in rng.normal(size=(400, 3))]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double")
    assert {r.g: r.degenerate for r in q.factored(q.estimates(df)).collect()} == {"flat": True, "line": True, "round": False}


def test_consistency_factor():
    assert abs(q.chi2_cdf(7.815, 3) - 0.95) < 1e-3 and abs(q.chi2_cdf(11.07, 5) - 0.95) < 1e-3
    assert abs(q.consistency(0.75) - 1.61) < 0.02


def test_small_groups_are_judged_too(spark):
    rng = np.random.default_rng(4)
    prose = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(60))
    odd = lambda: " ".join("#$%&*" * 12 + str(rng.integers(10**6)) for _ in range(60))
    groups = [("en", "large")] * 300 + [("en", "small")] * 10 + [("xx", "rare")] * 5
    rows = [(i, prose(), lang, source) for i, (lang, source) in enumerate(groups)] + [(900, odd(), "en", "small"), (901, odd(), "xx", "rare")]
    got = {r.doc_id: r for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r.distance is not None and not r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {900, 901}


def test_every_passing_row_has_a_distance(spark, data_dir):
    got = op7_quality_rules(spark, data_dir).collect()
    assert got and all((r.distance is None) == r.base_failed for r in got)
