"""Alignment against whole encodings and a search over all pairs of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tesserae.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
LETTERS = alignment._bytes_of_letters()
PARTS = ["a", "word", " ", "  ", "\n", "\t", "é", "漢字", "😀", "▁", "x▁y", "<|endoftext|>", "<s>", "<0x41>", "<unk>", "'ll", "123", "...", "\xa0", "\x85", "\x00", "ﬁ", "Ⅷ", "é", "​", "x" * 50]


def plain(texts):
    """Per text (A ids, B ids, groups, links) of whole encodings, all by the contract."""
    out = []
    for text in texts:
        a = A.encode(" " + text, add_special_tokens=False).ids if text else []
        b = B.encode(text) if text else []
        bytes_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in (bytes_a, bytes_b)):
            out.append(([], [], [], []))
            continue
        ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b)]
        both, groups, i, k = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for end in both:
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:x], b[k:y]))
            i, k = x, y
        links = [
            (a[i], b[k])
            for i in range(len(a))
            for k in range(len(b))
            if max(ends[0][i] - len(bytes_a[i]), ends[1][k] - len(bytes_b[k])) < min(ends[0][i], ends[1][k])
        ]
        out.append((a, b, groups, links))
    return out


def wanted(rows):
    told = plain([t or "" for _, t in rows])
    count = Counter(x for t in told for x in t[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (doc, _), (a, b, groups, links) in zip(rows, told, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((repr(doc), len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out), count


def got(frame):
    return sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


def text_of(rng):
    return rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60)))])


@pytest.mark.parametrize("seed", range(3))
def test_odd_texts_equal_whole_encodings(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, 2**53 + 1]), text_of(rng)) for i in range(60)]
    rows += rows[:3]
    docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, pair long, block binary")
    frame, counts = alignment.align_tokens(docs.repartition(3), *PATHS)
    want, count = wanted(rows)
    assert got(frame) == want
    assert {(r.a, r.b): r["count"] for r in counts.collect()} == count


def test_merge_gives_every_overlap_once():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randint(1, 30)
        a, b = (sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size}) for _ in "ab")
        i, k, both = alignment.merged(np.array(a), np.array(b))
        spans = [list(zip([0, *x], x, strict=False)) for x in (a, b)]
        overlap = [(m, n) for m, x in enumerate(spans[0]) for n, y in enumerate(spans[1]) if max(x[0], y[0]) < min(x[1], y[1])]
        assert list(zip(i.tolist(), k.tolist(), strict=True)) == overlap and both.tolist() == sorted({*a} & {*b})


def test_units_are_independent():
    """Encodings of units, joined, are the encoding of the whole."""
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12)))
        units = alignment.units_of(text)
        assert "".join(units) == " " + text and all(u[0] == " " for u in units)
        ids = [A.encode(u, add_special_tokens=False).ids for u in units]
        assert sum(ids, []) == A.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert sum((B.encode(u[1:]) for u in units), []) == B.encode(text)


def test_blocks_and_forgotten_units_change_nothing(spark, data_dir, monkeypatch):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").limit(60)
    one = got(alignment.align_tokens(docs, *PATHS)[0])
    held = alignment.Aligner(*PATHS)
    units = [u for r in docs.limit(3).collect() for u in alignment.units_of(r.text or "")][:120]
    want = alignment.Aligner(*PATHS).known(units)
    monkeypatch.setattr(alignment, "MEMO", 50)
    for at in range(0, len(units), 25):
        assert held.known(units[at : at + 25]) == want[at : at + 25] and len(held.fresh) <= 50 and len(held.stale) <= 75
    monkeypatch.setattr(alignment, "BLOCK", 5_000)
    assert got(alignment.align_tokens(docs, *PATHS)[0]) == one


def test_whole_table_equals_whole_encodings(spark, data_dir):
    from tesserae.llm.registry import QUERIES

    frame = QUERIES["op12_cross_tokenizer_alignment"](spark, data_dir)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 1500]
    told = {r.doc_id: r for r in frame.collect()}
    for (doc, _), (a, b, groups, links) in zip(rows, plain([t or "" for _, t in rows]), strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        r = told[doc]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links))
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if a else "")


def test_empty_table_and_whole_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokens(empty, *PATHS)[0].collect() == []
    frame, _ = alignment.align_tokens(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string"), *PATHS, whole=True)
    row = frame.first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") + 1 == row.n_groups
