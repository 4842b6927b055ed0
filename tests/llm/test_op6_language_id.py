"""Held-out accuracy, Viterbi against plain dynamic programming, and odd rows."""

import itertools
import zlib

import numpy as np

from tesserae.llm import language_id as lid
from tesserae.llm.registry import op6_language_id


def test_viterbi_equals_exhaustive_search():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 0, 6, 1, 5, 6])
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    got = lid.viterbi(lambda at: scores[at].copy(), sizes, 3, penalty=2.0)
    worth = lambda path, s: sum(s[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))
    at = 0
    for n in sizes:
        s = scores[at : at + n]
        best = max((worth(p, s) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(worth(got[at : at + n], s) - best) < 1e-9
        at += n


def test_held_out_rows(spark, d="/root/testdata/sf0.01"):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op6_language_id(spark, d).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97


def model(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the house and the garden with the tree", "en"), ("das haus und der garten mit dem baum", "de"), ("дом и сад и дерево в саду", "ru")] * 8)]
    return lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_and_scripts(spark):
    label = lid.labeller(model(spark), penalty=3.0)
    text = "the house and the garden, das haus und der garten mit dem baum"
    lang, score, spans = label([text])[0]
    assert lang == "de" and 0.5 < score < 0.7
    assert [(text[a:b], x) for a, b, x in spans] == [("the house and the garden", "en"), ("das haus und der garten mit dem baum", "de")]
    assert label(["щщщ"])[0][0] == "ru"


def test_odd_rows(spark):
    m = model(spark)
    rows = [(1, None), (2, ""), (3, "12 ²½ ?!"), (4, "漢字"), (5, "house " * 20_000), (None, "İSTANBUL und"), (6, "z" * 100_000), (6, "z" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = lid.predict(df, m).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {i: by[i].lang_pred for i in (1, 2, 3)} == dict.fromkeys((1, 2, 3), "und") and by[5].lang_pred == "en" and by[4].lang_pred in m.langs
    assert lid.predict(df.limit(0), m).count() == 0
    empty = lid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in lid.predict(df, empty).collect()} == {"und"}


def test_three_hundred_languages(spark):
    """Each language has a word of its own; labels beyond 255 must come back as they went in."""
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i * 7919 % 100_000:05d}")
    rows = [(4 * i, f"{word(i)} {word(i)[::-1]}x {word(i)}q", f"l{i:03d}", "z") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string")
    m = lid.fit(df)
    assert len(m.langs) >= 290
    label = lid.labeller(m, penalty=3.0)
    texts = {x: t for _, t, x, _ in rows}
    wrong = [x for x in m.langs if label([texts[x] * 2])[0][0] != x]
    assert len(wrong) <= 3, wrong
    long = " ".join(texts[m.langs[280]] for _ in range(40_000))
    assert label([long, texts[m.langs[299 if len(m.langs) > 299 else -1]]])[0][0] == m.langs[280]


def test_brute_force_of_the_query(spark, d="/root/testdata/sf0.001"):
    """Predictions of the whole table again, word by word with plain dictionaries."""
    from tesserae.llm.registry import documents

    docs = documents(spark, d)
    m = lid.fit(docs)
    for r, got in zip(docs.collect(), lid.predict(docs, m).collect(), strict=True):
        words = lid.LETTERS.findall((r.text or "").lower())
        best = {x: (0.0, ()) for x in m.langs}
        for k, w in enumerate(words):
            top = max(m.langs, key=lambda x: (best[x][0], -m.langs.index(x)))
            score = {x: sum(m.table[m.rows.get(g, 0), i] for g in lid.grams(w)) + m.scripts.get(lid.script(w), np.zeros(len(m.langs)))[i] for i, x in enumerate(m.langs)}
            best = {x: ((best[top][0] - lid.PENALTY, top) if k and best[top][0] - lid.PENALTY > best[x][0] else (best[x][0], x)) + (best,) for x in m.langs}
            best = {x: (v + score[x] - max(score.values()), (came, before[came][1], w)) for x, (v, came, before) in best.items()} if k else {x: (score[x] - max(score.values()), ((), (), w)) for x in m.langs}
        if not words:
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        now = max(m.langs, key=lambda x: (best[x][0], -m.langs.index(x)))
        held, node = dict.fromkeys(m.langs, 0), best[now][1]
        while node:
            held[now] += len(node[2])
            now, node = node[0], node[1]
        want = max(m.langs, key=lambda x: (held[x], -m.langs.index(x)))
        assert (got.doc_id, got.lang_pred) == (r.doc_id, want) and abs(got.score - held[want] / sum(held.values())) < 1e-9


def test_training_under_extra_columns_and_without_keys(spark):
    rows = [(None if i % 3 else i, f"{t} {i}", x, 1, 2, 3) for i, (t, x) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, rank int, chance int")
    m = lid.fit(df.repartition(3), per_lang=10)
    again = lid.fit(df.repartition(5, "text"), per_lang=10)
    assert m.langs == ["de", "en"] and m.rows == again.rows and (m.table == again.table).all()
