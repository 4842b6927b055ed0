"""Spans against plain searches, and the checksums."""

import base64
import hashlib
import itertools
import json
import random
import re
import time
import zlib

from tesserae.llm.secret_scan import BASE58, BASE62, crc62, finder, joined, masked, redact, scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_kinds_equal_plain_searches():
    rng = random.Random(3)
    pieces = ["token", "Token=", "api_key", "apikey: ", "ſecret=", "toKen=", "password", "passwd", '"', "'", "=", ":", " ", "AKIA", "AKIAAKIA", "Z" * 14, "abcdef0123456789", "abc", "İ", "é", "x=y", "secret = ", "=" * 12]
    find = finder()
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert [s for s in find(text) if s[0] in ("assign", "access", "hex")] == brute(text), text


def base58check(raw):
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return out


def test_checksums_decide():
    find = finder()
    body = "k3Jd9sLq0PzXcVbNm1QwErTyUiOp42"
    good = f"ghp_{body}{crc62(body)}"
    assert find(f"a {good} b") == [("github", 2, 42)]
    assert find(f"a {good[:-1]}{'0' if good[-1] != '0' else '1'} b") == []
    key = base58check(bytes.fromhex("0488ADE4") + bytes(range(74)))
    assert len(key) == 111 and find(key) == [("xprv", 0, 111)]
    assert find(key[:-1] + ("1" if key[-1] != "1" else "2")) == []
    assert find("x eyJhbGciOiJub25lIn0.eyJhIjoxfQ.zz y") == [("jwt", 2, 35)]
    assert find("x eyJhbGciOiJ.eyJhIjoxfQ.zz y") == []


def test_rows_and_masking(spark):
    rows = [(1, "a token = 'abcdefabcdefabcdef12' b", 1), (1, None, 2), (2, "", 3), (3, "clean", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = {(r.doc_id, r.spans, r.n_assign, r.n_hex) for r in scan(df).collect()}
    assert out == {(1, "assign:2:31,hex:11:31", 1, 1), (1, "", 0, 0), (2, "", 0, 0), (3, "", 0, 0)}
    assert sorted(str(tuple(r)) for r in redact(df).collect()) == sorted(map(str, [(1, "a [secret]' b", 1), (1, None, 2), (2, "", 3), (3, "clean", None)]))
    assert masked("0123456789", [("a", 1, 5), ("b", 3, 7), ("c", 8, 9)]) == "0[secret]7[secret]9"
    assert scan(df.limit(0)).count() == 0


def brute_added(text):
    """The added kinds by plain searches over the whole text, without keywords."""
    out = []
    for kind, pattern in (("github", r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), ("npm", r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")):
        for m in re.finditer(pattern, text):
            n, digits = zlib.crc32(m[1][:30].encode()), ""
            while len(digits) < 6:
                n, digits = n // 62, BASE62[n % 62] + digits
            out += [(kind, *m.span())] if digits == m[1][30:] else []
    for m in re.finditer(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])", text):
        raw = sum(BASE58.index(c) * 58**i for i, c in enumerate(reversed(m[0]))).to_bytes(84, "big")[-82:]
        out += [("xprv", *m.span())] if hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:] else []
    at = 0
    for run in re.finditer(r"[A-Za-z0-9_.-]+", text):
        parts = [(run.start() + m.start(), m[0]) for m in re.finditer(r"[A-Za-z0-9_-]+", run[0])]
        for (i, a), (j, b) in itertools.pairwise(parts):
            start = next((i + k for k in range(len(a)) if a.startswith("eyJ", k) and len(a) - k > 3), None)
            if start is None or start < at or not b.startswith("eyJ") or len(b) < 4 or j != i + len(a) + 1 or text[j + len(b) : j + len(b) + 1] != ".":
                continue
            if opened(text[start : i + len(a)]) and opened(b):
                at = j + len(b) + 1 + len(re.match("[A-Za-z0-9_-]*", text[j + len(b) + 1 :])[0])
                out.append(("jwt", start, at))
    return out


def opened(part):
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "===")), dict)
    except ValueError:
        return False


def test_added_kinds_equal_plain_searches():
    rng, find = random.Random(8), finder()
    body = "k3Jd9sLq0PzXcVbNm1QwErTyUiOp42"
    key = base58check(bytes.fromhex("0488ADE4") + bytes(range(74)))
    pieces = [f"ghp_{body}{crc62(body)}", f"npm_{body}{crc62(body)}", f"gho_{body}000000", "ghp_", key, key[:-1] + "1", "eyJhbGciOiJub25lIn0", ".", ".", "eyJhIjoxfQ", "eyJ", "x", " ", "EYJ", "-", "İ"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        got = [s for s in find(text) if s[0] not in ("assign", "access", "hex")]
        assert sorted(got) == sorted(brute_added(text)), text


def test_very_long_texts_take_time_in_proportion():
    find = finder()
    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    started = time.process_time()
    assert find(f"x {deep}.{deep}.z") == []
    assert [s for s in find("eyJ" * 1_000_000 + " " + "token " * 300_000 + "token=abcdefabcdef") if s[0] == "assign"] == [("assign", 4_800_001, 4_800_019)]
    assert find("password" + " " * 2_000_000 + "=" * 2_000_000)[0][0] == "assign"
    assert len(find("token=" * 500_000)) == 1
    assert time.process_time() - started < 30


def test_whole_table(spark, data_dir="/root/testdata/sf0.01"):
    from tesserae.llm.registry import op10_secret_scan

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = op10_secret_scan(spark, data_dir).collect()
    assert len(got) == len(docs) and any(r.n_assign for r in got)
    for r in got:
        want = brute(docs[r.doc_id])
        added = [s for s in (x.split(":") for x in r.spans.split(",") if x) if s[0] not in ("assign", "access", "hex")]
        assert sorted((k, int(a), int(b)) for k, a, b in added) == sorted(brute_added(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
