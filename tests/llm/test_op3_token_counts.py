"""Counts against plain encodings of whole texts."""

import json
import random
import time

import public_tokenizers
import pytest

from tesserae.llm.token_counts import count_tokens, counter, last_stable, load, splice

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [".", "'", "。", "д", "'ll", "ab", "_", "７", "²", "a", "é", " ", "  ", "\n", "'s", "1", "<|endoftext|>", "!!", "\x1c", "　", "漢", "😀", "\r\n", "x" * 40, "<|endof", "\xa0"]


TOKENIZER, ADDED = load(PATH)


def plain(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False))


def offsets(text):
    return TOKENIZER.encode(text, add_special_tokens=False).offsets


@pytest.mark.parametrize("seed", range(5))
def test_splice_equals_whole_encoding(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 300)))
        got, _ = splice(text, offsets, rng.randint(5, 60), rng.randint(1, 8), ADDED)
        assert got == plain(text)


def test_overlap_widens_where_there_is_no_space():
    text = "abx" * 400 + " end"
    got, widened = splice(text, offsets, 100, 8, ADDED)
    assert got == plain(text) and widened > 0
    assert splice("ab1" * 400 + " end", offsets, 100, 8, ADDED) == (plain("ab1" * 400 + " end"), 0)


def test_every_stable_place_begins_a_token_in_every_chunk():
    rng = random.Random(5)
    for _ in range(250):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(2, 25)))
        whole = {a for a, _ in offsets(text)}
        for at in range(1, len(text)):
            if last_stable(text, at, at + 1, ADDED) == at:
                assert at in whole
                a, b = rng.randint(0, at - 1), rng.randint(at + 1, len(text))
                assert at - a in {x for x, _ in offsets(text[a:b])}


def test_long_runs_take_little_more_than_a_plain_encoding():
    rng = random.Random(3)
    for text in ("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(400_000)), "word, " * 100_000, "天气，" * 100_000):
        a = time.process_time()
        want = plain(text)
        b = time.process_time()
        assert counter(PATH)([text]) == [want]
        assert time.process_time() - b < 3 * (b - a) + 1


def test_other_tokenizers_are_refused(tmp_path):
    told = json.load(open(PATH, encoding="utf-8"))
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**told["pre_tokenizer"], "add_prefix_space": True}}, {"normalizer": {"type": "NFC"}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps({**told, **change}), encoding="utf-8")
        load.cache_clear()
        with pytest.raises(ValueError, match="proven"):
            load(str(path))


def test_counts_equal_whole_encoding():
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["w" * 40_000, "word " * 20_000]
    assert counter(PATH)(texts) == [plain(t) for t in texts]


def test_query_columns_and_odd_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", "n_tokens"), (None, "z" * 5000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = count_tokens(df, PATH, limit=1)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    out = sorted((tuple(r) for r in got.collect()), key=str)
    want = sorted([(i, len((t or "").encode()), plain(t or ""), plain(t or "") > 1) for i, t, _ in rows], key=str)
    assert out == want
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_whole_table(spark, data_dir):
    from tesserae.llm.registry import op3_token_counts

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    for r in op3_token_counts(spark, data_dir).collect():
        assert (r.n_bytes, r.n_tokens) == (len((docs[r.doc_id] or "").encode()), plain(docs[r.doc_id] or ""))
