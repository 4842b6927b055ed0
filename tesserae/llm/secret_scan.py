"""Secret scans of whole texts.

An Aho-Corasick automaton finds the keywords that a secret can begin with, anchored regular
expressions run only at those hits, and kinds with an embedded checksum are validated. Hexadecimal
runs have no keyword; their expression is anchored by its own character class.

Kinds in order: ``assign``, ``access``, ``hex`` (the base kinds, leftmost and non-overlapping each),
then ``github`` and ``npm`` (base-62 CRC-32 over the body), ``xprv`` (Base58Check) and ``jwt`` (its
first two parts must decode to JSON objects). Spans are code points, end exclusive.

A text is read once from left to right, and no run of characters more than three times, so very long
texts take time in proportion. Null and empty texts have no spans; repeated rows are scanned one by
one; extra columns are ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("assign", "access", "hex", "github", "npm", "xprv", "jwt")
#: Keywords in lower case and the kind whose expression is tried there (fixed values).
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "xprv": "xprv", "eyj": "jwt",
}
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
JWT_PART = re.compile(r"[A-Za-z0-9_-]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc62(body: str) -> str:
    """The six base-62 digits of a body's CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def checked62(body: str) -> bool:
    return crc62(body[:-6]) == body[-6:]


def checked58(text: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of the rest."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b"\0" * 82
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def is_json(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):  # too deeply nested to be the header of a token
        return False


def _accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(1) - m.start(1) >= 12
    if kind == "access":
        return m.end() - m.start() >= 18
    if kind in ("github", "npm"):
        return checked62(m[1])
    if kind == "xprv":
        return checked58(m[0])
    return is_json(m[1]) and is_json(m[2])


ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "xprv": XPRV, "jwt": JWT}


def lowered(text: str) -> str:
    """Lower case, every character in its place; a prefilter only, the expressions decide."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def finder() -> Callable[[str], list[tuple[str, int, int]]]:
    """A function from a text to its accepted spans (kind, start, end), by start and then kind."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    rank = {k: i for i, k in enumerate(KINDS)}

    def find(text: str) -> list[tuple[str, int, int]]:
        spans = [("hex", *m.span()) for m in HEX.finditer(text)]
        over = dict.fromkeys(KINDS, 0)
        # A match takes its text whether it is accepted or not, as a search from the left would.
        for start, kind in sorted((end + 1 - n, kind) for end, (n, kind) in automaton.iter(lowered(text))):
            if start < over[kind]:
                continue
            if m := ANCHORED[kind].match(text, start):
                over[kind] = m.end()
                if _accept(kind, m):
                    spans.append((kind, *m.span()))
                elif kind == "jwt":  # its second part may begin the true one
                    over[kind] = m.end(1)
            elif kind == "jwt":  # every other start in this run would fail at the same end
                over[kind] = JWT_PART.match(text, start).end() if text.startswith("eyJ", start) else start + 1
        return sorted(spans, key=lambda s: (s[1], rank[s[0]]))

    return find


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256 and spans. One pass, no shuffle."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        find = finder()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for t in batch.column(1).to_pylist():
                found = find(t or "")
                for out, kind in zip(counts, KINDS, strict=False):
                    out.append(sum(s[0] == kind for s in found))
                digests.append(hashlib.sha256(joined([s for s in found if s[0] in KINDS[:3]]).encode()).hexdigest())
                spans.append(joined(found))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return work

    slim = docs.select(docs[key].alias(key), docs[text].alias("text"))
    kind = slim.schema[key].dataType.simpleString()
    return shared.arrow_map(slim, f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones merged, replaced by ``[secret]``."""
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in the text masked; texts without one, and nulls, stay as they are."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        find = finder()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            place = batch.schema.get_field_index(text)
            clean = [t and masked(t, find(t)) for t in batch.column(place).to_pylist()]
            return batch.set_column(place, batch.schema.field(place), pa.array(clean, batch.schema.field(place).type))

        return work

    return shared.arrow_map(docs, shared.ddl(docs), make, text=docs.columns.index(text))


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` set to the length of the text, as redaction may change it."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))
