"""Each stage against a brute-force version on its own input."""

import itertools

from pyspark.sql import functions as F
from test_op10_secret_scan import brute, brute_added

import corpus_pipeline as cp
from tesserae.llm import decontaminate, shared, simhash, source_mix, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = cp.toxicity(spark, docs, SF)
    assert clean.columns == COLUMNS
    # Scores are held against plain edit distances in test_op8_toxicity.
    told = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").collect()}
    assert {r.doc_id for r in clean.collect()} == told and len(told) < len(by)
    unique = shared.stored(cp.near_duplicates(spark, clean, SF), "u")
    assert unique.columns == COLUMNS
    kept = {r.doc_id for r in unique.collect()}
    assert kept == brute_unique({i: by[i].text for i in told})
    held = cp.decontamination(spark, unique, SF)
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clear = {i for i in kept if not any(overlap(decontaminate.tokens(by[i].text), x) for x in items)}
    assert {r.doc_id for r in held.collect()} == clear and clear < kept
    masked = cp.secrets(spark, held, SF).collect()
    assert {r.doc_id for r in masked} == clear
    for r in masked:
        text = by[r.doc_id].text
        hidden = {k for _, a, b in brute(text) + brute_added(text) for k in range(a, b)}
        want = "".join("[secret]" if k - 1 not in hidden else "" for k in range(len(text)) if k in hidden)
        assert r.text.count("[secret]") >= len(want) // 8 > -1 and r.n_chars == len(r.text)
        assert r.text.replace("[secret]", "") == "".join(c for k, c in enumerate(text) if k not in hidden)
    mixed = cp.run(spark, SF)
    assert mixed.columns == [*COLUMNS, "copies", "taken"]
    plan = {r.doc_id: (r.copies, r.taken) for r in source_mix.mix(spark.createDataFrame(masked)).collect()}
    final = {r.doc_id: r.text for r in masked}
    got = mixed.collect()
    assert {r.doc_id: (r.copies, r.taken) for r in got} == {i: v for i, v in plan.items() if v[1]}
    assert len(got) < len(masked) and all(r.text == final[r.doc_id] and r.taken == r.copies * len(r.text.split()) for r in got)


def overlap(theirs, mine):
    """Whether some window of an item agrees with the text, position by position."""
    w = min(decontaminate.WINDOW, len(mine))
    for shift in range(1 - len(mine), len(theirs)) if w else ():
        low, high = max(0, -shift), min(len(mine), len(theirs) - shift)
        if high - low < 0.8 * w:
            continue
        equal = [0] + list(itertools.accumulate(low <= j < high and theirs[j + shift] == x for j, x in enumerate(mine)))
        if any(b - a >= decontaminate.AGREE * w for a, b in zip(equal, equal[w:], strict=False)):
            return True
    return False


def brute_unique(texts, radius=64):
    ids = sorted(texts)
    fps = {i: simhash.fingerprint(texts[i]) for i in ids}
    grams = {i: set(simhash.shingles(texts[i], 5)) for i in ids}
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = grams[i], grams[j]
            copy = (texts[i] or "") == (texts[j] or "") or (len(a) <= len(b) / 0.8 and len(b) <= len(a) / 0.8 and (fps[i] ^ fps[j]).bit_count() <= radius and len(a & b) >= 0.8 * len(a | b))
            if copy and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i for i in ids if find(i) == i}


def test_deduplicate_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w77 ", "other ")
    half = " ".join(f"w{i}" for i in range(100)) + " " + " ".join(f"v{i}" for i in range(100))
    rows = [(5, base), (3, near), (9, half), (9, half), (1, None), (2, ""), (None, base), (None, None), (7, base.upper()), (8, "tiny"), (4, "tiny"), (6, "x " * 30_000)]
    df = spark.createDataFrame([(i, t, "en", None, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for members in (4096, 2):
        got = sorted((r.doc_id for r in simhash.deduplicate(df, members=members).collect()), key=lambda i: (i is None, i))
        assert got == [1, 3, 4, 6, 9, None, None], members
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_extra_columns_do_not_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    wide = docs.withColumns({c: F.lit(1) for c in ("hash", "fp", "node", "root", "size", "copies", "toxic", "k_id")})
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == COLUMNS
    assert cp.mixture(spark, wide, SF).columns == [*COLUMNS, "copies", "taken"]


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and a table without rows."""
    long = " ".join(f"w{i}" for i in range(60_000))
    quoted = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, None, "en", "a"), (1, None, "en", "a"), (2, "", None, None), (None, None, None, None), (None, "plain words here", None, "a"), (3, long, "en", "a"), (3, long, "en", "a")]
    rows += [(4, "token = abcdefghijklmnop", "en", "b"), (5, f"so {quoted} it ends", "de", None), (5, f"so {quoted} it ends", "de", None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: (str(r[0]), (r[1] or "")[:40], r[1] is None)
    told = lambda out: sorted(key(r) for r in out.select("doc_id", "text").collect())
    assert told(cp.toxicity(spark, df, SF)) == sorted(map(key, rows))
    assert told(cp.near_duplicates(spark, df, SF)) == sorted(map(key, [rows[0], *rows[3:6], *rows[7:9]]))
    assert told(cp.decontamination(spark, df, SF)) == sorted(map(key, rows[:8]))
    masked = cp.secrets(spark, df, SF)
    assert told(masked) == sorted(map(key, [*rows[:7], (4, "[secret]"), *rows[8:]]))
    assert {(r.text is None, r.n_chars) for r in masked.where("text is null or doc_id = 4").collect()} == {(True, None), (False, 8)}
    mixed = {(r.doc_id, r.source): r.copies for r in cp.mixture(spark, df, SF).collect()}
    assert mixed and all(c > 0 for c in mixed.values()) and mixed.keys() <= {(None, "a"), (3, "a"), (4, "b"), (5, None)}
    docs = df.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_duplicates_equal_jaccard_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_unique(texts)
    assert want != brute_unique(texts, radius=8)  # a pair that SimHash at 8 bits alone would miss
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()} == want
