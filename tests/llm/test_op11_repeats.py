"""Removed words against a plain search over all windows, and SQL on the driver's tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import repeats, shared, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, depth):
    """Per (doc_id, text): words, removed, what is left; by the contract, window by window."""
    rows = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    seen, out = set(), {}
    for doc, text in rows:
        found = WORD.findall(text)
        gone = set()
        for i in range(len(found) - depth + 1):
            run = tuple(found[i : i + depth])
            if run in seen:
                gone.update(range(i, i + depth))
            seen.add(run)
        left = [w for i, w in enumerate(found) if i not in gone]
        out[doc, text] = (len(found), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest(), sorted(gone))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "é", "漢字", "w" * 70, "w" * 70 + "x", "\xa0"]
    passage = " ".join(rng.choice(letters) for _ in range(40))
    rows = []
    for i in range(rng.randint(1, 25)):
        kind = rng.random()
        if kind < 0.1:
            text = rng.choice([None, "", " ", "\n\t", "a"])
        elif kind < 0.5:
            text = rng.choice([" ", "\n", "  "]).join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        else:
            cut = rng.randint(0, 30)
            text = " ".join([rng.choice(letters), passage[cut : cut + rng.randint(10, 90)], rng.choice(letters)])
        rows.append((rng.choice([None, i, i, i, rng.randint(0, 5), 2**53 + i]), text))
    return rows + rng.sample(rows, min(3, len(rows)))


def compare(spark, rows, depth, group=repeats.GROUP):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, run string, salt int")
    got = repeats.cut_repeats(docs, depth, group).collect()
    want = plain(rows, depth)
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((repr(d), *want[d, t or ""][:3]) for d, t in rows)
    for r in got:
        assert sum(s.n_words for s in r.spans) == r.n_removed
        if r.kept is not None:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("seed", range(4))
def test_odd_rows_equal_a_plain_search(spark, seed):
    compare(spark, rows_of(seed), 3 + 3 * seed)


def test_frequent_prefixes_are_made_longer_and_dealt_out(spark, monkeypatch):
    """With groups of one suffix every prefix is too frequent, and every node is dealt out by document."""
    rows = [(i, "a b c d e f g h i j " * 2 + str(i % 7)) for i in range(40)]
    deals = []
    monkeypatch.setattr(repeats, "LOW", 1)
    grouped = repeats._grouped

    def spied(*args):
        out = grouped(*args)
        deals.append(out.agg(F.max("salt"), F.count_distinct("salt")).first())
        return out

    monkeypatch.setattr(repeats, "_grouped", spied)
    compare(spark, rows, 5, 1)
    assert deals[0][0] > 1 and deals[0][1] > 2


def test_tables_without_rows_or_windows(spark):
    compare(spark, [], 20)
    compare(spark, [(1, None), (2, ""), (3, "a b"), (None, "a b")], 20)


def test_whole_table_equals_sql(spark, data_dir):
    from tesserae.llm.registry import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    got = QUERIES["op11_substring_dedup"](spark, data_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(ORACLE["op11_substring_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got.n_removed.sum() > 0 and got.equals(want.astype(got.dtypes))


def test_words_runs_and_least_places():
    rng = random.Random(1)
    texts = [rng.choice([None, "", "a", " b ", "c\x0bd", "é\xa0f g" * 3, "x" * 100 + " y"]) for _ in range(50)]
    w = words.split(pa.array(texts))
    want = [WORD.findall(t or "") for t in texts]
    flat = [x for t in want for x in t]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == flat
    assert np.diff(w.first).tolist() == [len(t) for t in want]
    assert [x.decode() for x in w.joined()] == [" ".join(t) for t in want]
    h = w.hashes()
    assert len({int(x) for x in h}) == len(set(flat))
    for n in (1, 2, 3, 7, 8, 20):
        r = words.runs(h, n)
        assert len(r) == max(0, len(h) - n + 1)
        assert len({int(x) for x in r}) == len({tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)})
    v = np.array([3, 1, 1, 2, 0, 5], np.uint64)
    assert words.least(v, 3).tolist() == [1, 1, 4, 4]


def test_sieve_places_are_those_of_spark(spark):
    keys = spark.createDataFrame([(x,) for x in (0, 1, -1, 2**63 - 1, -(2**63), 12345678901)], "h long")
    s = shared.Sieve(None, 1 << 20)
    want = [list(r) for r in keys.select(*s.places(F.col("h"))).collect()]
    got = repeats._places(np.array([r.h for r in keys.collect()]).view(np.uint64), 1 << 20)
    assert [list(x) for x in zip(*[g.tolist() for g in got], strict=True)] == want
