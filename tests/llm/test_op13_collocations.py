"""Collocations against a plain count over all phrases, and SQL on the driver's tables."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.llm import collocations

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least, longest=5, cover=100, best=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(found)
            for i in range(len(found)):
                for n in range(1, min(longest, len(found) - i) + 1):
                    count[lang, tuple(found[i : i + n])] += 1
    often = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in often.items():
        cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(
            q_lang == lang and len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (q_lang, q), b in often.items()
        )
        if not inside:
            out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(own[:best], 1)]
    return sorted(ranked)


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", range(4))
def test_odd_rows_equal_a_plain_count(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "É", "漢", "x" * 70, "\xa0", "c", "\x1c"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", "!", ",", "\x0b"]
    rows = []
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice([None, "und", "en", "x y", ""]), rng.choice([None, "", text, text, text])))
    rows += rows[:10]
    docs = spark.createDataFrame([(1, t, g, 5, "p") for g, t in rows], "doc_id long, text string, lang string, m int, piece string")
    assert got(collocations.mine(docs.repartition(3), least=3, best=15)) == plain(rows, 3, best=15)


def test_hot_pieces_long_texts_and_cover(spark):
    rows = [("en", "alpha beta gamma. " * 3)] * 400 + [("en", "alpha beta " * 5000), ("en", "beta gamma delta epsilon zeta\n" * 500)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for cover in (100, 60):
        assert got(collocations.mine(docs, least=100, cover=cover)) == plain(rows, 100, cover=cover)


def test_products_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big - 1, 1), ("en", "a b", big - 7, 2)], "lang string, phrase string, f long, n int")
    row = collocations.score(counts, spark.createDataFrame([("en", 7 * big)], "lang string, n long")).first()
    assert row.score == 1000 * (big - 7) * 7 * big // (big * (big - 1)) and (row.l, row.r) == (big, big - 1)


def test_hashes_that_meet_are_told_apart():
    import numpy as np

    parts = [np.array([1, 2, 1, 2, 3]), np.array([5, 5, 5, 6, 5])]
    first, group = collocations._groups(np.array([9, 9, 9, 8, 9]), parts)
    assert len(first) == 4 and len(set(zip(parts[0].tolist(), parts[1].tolist(), group.tolist(), strict=True))) == 4
    assert all((p[first][group] == p).all() for p in parts)


def test_tables_without_phrases(spark):
    for rows in ([], [("en", None), (None, ""), ("en", "..."), ("en", "a b")]):
        assert collocations.mine(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_duckdb_spills_and_leaves_nothing(spark, monkeypatch, tmp_path):
    """Far more groups than the memory limit holds are summed exactly."""
    rows = spark.range(0, 600_000).select(F.lit("en").alias("lang"), F.concat(F.lit("w" * 60), F.col("id") % 300_000).alias("phrase"), F.lit(1).cast("long").alias("f"))
    monkeypatch.setattr(collocations, "_spill", lambda _: str(tmp_path / "spill"))
    summed = collocations._summed(rows.coalesce(1), 2, "48MB")
    assert summed.agg(F.count("*"), F.sum("f"), F.max("f")).first()[:] == (300_000, 600_000, 2)
    assert not list((tmp_path / "spill").glob("*"))


def test_whole_table_equals_sql(spark, data_dir):
    from tesserae.llm.registry import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    frame = QUERIES["op13_phrase_collocations"](spark, data_dir)
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLE['op13_phrase_collocations']})").fetchall()
    assert want and got(frame) == sorted(want)
