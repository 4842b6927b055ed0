"""Terms listed by blocks of rows, and what is made from them, against plain counts."""

import random
from collections import Counter

from tesserae.operators import search as se


def texts_of(spark, n, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "é", "- ."]) if i % 17 == 0 else " ".join(f"W{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(1, 40)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "_row_idx long, text string")


def counted(rows):
    out = Counter()
    for i, text in rows:
        words = [w.lower() for w in (text or "").split() if len(w) > 1]
        out.update((t, i) for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    return out


def test_lists_hold_every_term_of_every_row(spark):
    rows, df = texts_of(spark, 120)
    for most in (1, 300, 10**6):
        lists = se.listed_terms(df.coalesce(1), "_row_idx", "text", most)
        got = {(r.term, r._row_idx): r.tf for r in se.postings(lists, "_row_idx", "term").collect()}
        assert got == dict(counted(rows)), most
    assert lists.count() == lists.select("term").distinct().count()


def test_an_index_has_a_term_once_a_block_and_not_once_a_row(spark, tmp_path):
    rows, df = texts_of(spark, 200)
    path = f"file://{tmp_path}/index"
    se.build_index(df.coalesce(1), path)
    df_of = Counter(t for t, _ in counted(rows))
    known = sum(2 <= n <= 0.9 * 200 for n in df_of.values())
    assert spark.read.parquet(f"{path}/postings").count() == known
    for query in ("w1 w2", "w3 w3 w4", "nothing"):
        one, other = ([(r[0], round(r[1], 9)) for r in x.collect()] for x in (se.search_index(spark, path, query, 7), se.search(df, query, 7)))
        assert one == other, query


def test_a_search_without_an_index_counts_terms_by_blocks(spark, monkeypatch):
    rows, df = texts_of(spark, 60)
    monkeypatch.setattr(se, "counted_terms", None)
    assert se.search(df, "w1 w2", 3).count() == 3
