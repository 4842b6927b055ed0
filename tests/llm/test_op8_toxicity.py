"""The automaton against edit distance, context, and held-out accuracy."""

import math
import random
import re
import zlib

import pytest

from tesserae.llm import toxicity as t
from tesserae.llm.registry import op8_toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("states", [50_000, 5])
def test_automaton_equals_edit_distance(states):
    rng = random.Random(2)
    terms = ["idiot", "abba", "abbas", "aabbab", "ba", "bababab"]
    lexicon = t.Lexicon(terms, states=states)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 8))) for _ in range(3000)] + ["idiot", "idot", "idiots", "1diot", "didiot", "idito"]
    for w in words:
        near = [(distance(w, x), x) for x in terms if distance(w, x) <= int(len(x) >= t.FUZZY)]
        got = lexicon.find(w)
        assert (got is None) == (not near) and (got is None or (got[1], got[0]) == min(near)), w


def test_stems_match_beginnings():
    lexicon = t.Lexicon(["idiot"], ["lowei", "idio"])
    assert lexicon.find("loweischaft") == ("lowei", 0) and lexicon.find("lowe") is None and lexicon.find("xlowei") is None
    assert t.Lexicon(["loser", "idiot"], loud=["loser"]).find("closer") is None
    assert lexicon.find("idiotic") == ("idio", 0) and lexicon.find("idxot") == ("idiot", 1)


def test_choice_of_terms_and_stems():
    counts = [("=loweia", 30, 0), ("^lowe", 90, 0), ("^lowei", 90, 0), ("^loweia", 30, 0), ("=chance", 4, 0), ("^vequ", 80, 1), ("^vequa", 40, 0)]
    assert t.chosen(counts, 300, 3000, floor=32.0) == (["loweia"], ["lowei", "vequ"])


def test_context_tells_quotation_from_abuse():
    scan = t.scanner(["idiot"])
    kinds = lambda text: dict(zip(t.FEATURES, scan(text), strict=True))
    assert kinds("you are an idiot now")["addressed"] > 0 and kinds("you are an idiot now")["direct"] > 0
    assert kinds("what an Idi0t")["direct"] > 0 and scan("what an idxxt") == scan("")
    assert kinds('he read "an idiot abroad" there')["quoted"] > 0 and kinds("she said idiot")["quoted"] > 0
    assert scan("") == scan("nothing here") == [0.0] * 4


def test_held_out_rows(spark, d="/root/testdata/sf0.1"):
    got = {r.doc_id: r for r in op8_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(got[i].score, got[i].predicted, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    told = [y for _, p, y in held if p]
    assert sum(told) / len(told) > 0.9
    assert sum(p == y for _, p, y in held) / len(held) > 0.97


def test_odd_rows(spark):
    rows = [(1, "a moron x", "l"), (1, "a moron x", "l"), (None, None, None), (3, "", "s"), (4, "word " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 1), (9, None, 0)], "doc_id long, toxic int, quality int")
    for given in (labels, labels.limit(0)):
        model = t.fit(docs, given)
        got = t.score(docs, model).collect()
        assert len(got) == 5 and all(r.score is not None for r in got)
        assert t.score(docs.limit(0), model).count() == 0
    model = t.Model(["moron"], [9.0, 0.0, 0.0, 0.0, -3.0])
    assert {r.doc_id: r.predicted for r in t.score(docs, model).collect()} == {1: 1, None: 0, 3: 0, 4: 0}
    assert sorted(map(str, t.clean(docs, model).collect())) == sorted(map(str, docs.where("doc_id is null or doc_id > 1").collect()))


def test_spared_words_leave_their_terms_fuzzy():
    lexicon = t.Lexicon(["moron", "scum"], ["lowei"], spared=["=oron", "^lowe"], stem_edits=True)
    assert lexicon.find("oron") is None and lexicon.find("lowerei") is None
    for word, hit in {"m0ron": "moron", "morron": "moron", "scumm": "scum", "l0weixx": "lowei", "xloweixx": "lowei"}.items():
        assert lexicon.find(word) == (hit, 1), word


def test_misspelled_terms_of_the_table_are_hits(spark, d="/root/testdata/sf0.1"):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = t.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scan = t.scanner(model.terms, model.stems, model.spared)
    assert {"moron", "scum"} <= set(model.terms) and "=oron" in model.spared
    assert scan("the oron there") == [0.0] * 4
    for word in ("m0ron", "morron", "scumm"):
        assert scan(f"the {word} there")[0] > 0, word


def labelled(spark, rows):
    """Documents and labels from (doc_id, text, toxic), with extra columns whose names clash."""
    docs = spark.createDataFrame([(i, text, 7, 8, 9) for i, text, _ in rows], "doc_id long, text string, toxic int, group int, f int")
    return docs, spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, text string")


def prose(rng, n=40):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_models_do_not_depend_on_partitions(spark, d="/root/testdata/sf0.01"):
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    first, again = (t.fit(docs.repartition(n, "text"), labels.repartition(n + 1)) for n in (3, 7))
    assert first == again and first.terms


def test_a_common_long_word_and_copies_cost_no_training_row(spark):
    rng = random.Random(4)
    rows = [(i, f"{prose(rng)} {'blorg' if i % 3 == 0 else ''} {'footer' * 8}", int(i % 3 == 0)) for i in range(300)]
    copied = f"{prose(rng, 80)} zanzibar"
    rows += [(1000 + i, f"{copied} {prose(rng, 2)}", 1) for i in range(40)]
    model = t.fit(*labelled(spark, rows))
    assert "blorg" in model.terms and "zanzibar" not in model.terms
    scan = t.scanner(model.terms, model.stems, model.spared)
    assert scan("a blorg")[0] > 0 and -7 < model.weights[-1] < 0


def test_training_learns_whether_quotation_is_abuse(spark):
    rng = random.Random(6)

    def rows(quoted_is_toxic):
        out = []
        for i in range(600):
            a, b = prose(rng, 15), prose(rng, 15)
            direct, quoted, plain = f"{a} you blorg {b}", f"{a} \u201cyou blorg\u201d he wrote {b}", f"{a} he wrote {b}"
            out.append((i, (direct, quoted, plain)[i % 3], int(i % 3 == 0 or (i % 3 == 1 and quoted_is_toxic))))
        return out

    probe = spark.createDataFrame([(1, "a b you blorg c d"), (2, "a b \u201cyou blorg\u201d she said c d"), (3, "a b c d")], "doc_id long, text string")
    for toxic, want in ((False, {1: 1, 2: 0, 3: 0}), (True, {1: 1, 2: 1, 3: 0})):
        model = t.fit(*labelled(spark, rows(toxic)), held=1000)
        assert {r.doc_id: r.predicted for r in t.score(probe, model).collect()} == want
        assert (model.weights[t.FEATURES.index("quoted")] > 1) == toxic


def test_scores_equal_brute_force(spark, d="/root/testdata/sf0.001"):
    """Every score of the query's table from the model by plain edit distances."""
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    model = t.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    known = {}

    def hit(w):
        if w in model.terms or any(w.startswith(x) for x in model.stems):
            return True
        if "=" + w not in model.spared and any(abs(len(x) - len(w)) < 2 and len(x) >= t.FUZZY and distance(w, x) < 2 for x in model.terms):
            return True
        near = {"^" + w[:k] for x in model.stems if len(x) >= t.FUZZY for k in (len(x) - 1, len(x), len(x) + 1) if k <= len(w) and distance(w[:k], x) < 2}
        return bool(near) and not near & set(model.spared)

    def score(text):
        low = text.lower()
        places = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", low)]
        direct = quoted = addressed = 0
        for i, (a, b, w) in enumerate(places):
            if w not in known:
                known[w] = hit(w)
            if not known[w]:
                continue
            lo, hi = max(0, i - t.WINDOW), min(len(places) - 1, i + t.WINDOW)
            near = {x for k, (_, _, x) in enumerate(places) if lo <= k <= hi and k != i}
            if (set(low[places[lo][0] : a]) & set(t.QUOTES) and set(low[b : places[hi][1] + 1]) & set(t.QUOTES)) or near & t.SAYING:
                quoted += 1
            else:
                direct += 1
            addressed += bool(near & t.ADDRESS)
        x = [math.log1p(v) for v in (direct, quoted, addressed, 100 * direct / max(1, len(places)))]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, [*x, 1.0], strict=True))))

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = t.score(docs, model).collect()
    assert len(got) == len(texts) and sum(r.predicted for r in got) > 0
    for r in got:
        want = score(texts[r.doc_id] or "")
        assert abs(r.score - want) < 1e-9 and r.predicted == int(want >= 0.5), r.doc_id
