"""Token counts of whole texts by overlap resynchronisation.

Every text is cut into overlapping chunks of ``CHUNK`` characters (a text of one chunk has no
overlap), each chunk is encoded with offsets, and neighbouring encodings are spliced where both
have a token boundary that is *proven stable*. When the overlap holds no such boundary it is widened
fourfold; when there is none at all since the last splice, the chunk itself grows fourfold and is
encoded anew from there, so that the work stays in proportion to the text.

Why a boundary is stable. The pre-tokeniser of a byte-level BPE works from left to right with the
alternatives contraction, ``space? letters``, ``space? digits``, ``space? others``, and space runs.
A match that holds a character which is not white space ends before the next white space, whatever
stands before it. It ends as well where letters, digits and others meet, since only a contraction
mixes them: there an apostrophe comes before letters, so an apostrophe proves nothing. Places of
these kinds begin a pre-token in the whole text and in any chunk that holds both characters. Letters,
digits and others are taken from ranges on which all Unicode tables agree. BPE never merges across
pre-tokens. Added tokens are cut out first; a place within one is not stable, and as none of them
begins as another ends, a cut chunk can't take one for another. Hence tokens left of a stable place
depend only on text left of it, and likewise on the right. ``load`` checks that the tokenizer is
of this kind.

Memory is bounded by one Arrow slice of texts and by the encoding of the longest stretch without a
stable place (a pre-token that the library itself has to hold whole), or four times a chunk.

Nulls count as empty texts. Repeated rows are counted one by one. Any extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Characters of one chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 32_768, 256
#: White space whose meaning all Unicode tables share, and other characters that some table takes as such (fixed values).
PLAIN = "\x20\t\n\r\f\v"
ODD = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Ranges of letters, digits and other characters on which all Unicode tables agree (fixed values).
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba\u03b1-\u03c1\u03c3-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0905-\u0939\u0e01-\u0e30\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
DIGIT = "0-9"
OTHER = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\u3001\u3002\u3008-\u3011\uff01\uff08\uff09\uff0c\uff0e\uff1a\uff1b\uff1f"
BOUNDARY = re.compile(
    f"(?<=[^{PLAIN}{ODD}])(?=[{PLAIN}])|(?<=[{LETTER}])(?=[{DIGIT}{OTHER}])|(?<=[{DIGIT}])(?=[{LETTER}{OTHER}])|(?<=[{OTHER}])(?=[{LETTER}{DIGIT}])"
)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer at ``path`` and its added tokens, once per Python process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    before = told.get("pre_tokenizer") or {}
    if (told["model"]["type"], before.get("type"), before.get("use_regex", True), before.get("add_prefix_space", True), told.get("normalizer")) != ("BPE", "ByteLevel", True, False, None):
        raise ValueError("boundaries are proven for byte-level BPE with the usual expression, without normaliser and prefix space, only")
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("an added token looks at its neighbours, so boundaries are not stable")
    for a in added:
        for b in added:
            if any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (a != b))) or (a != b and b in a):
                raise ValueError(f"added tokens can overlap, so boundaries are not stable: {a!r}, {b!r}")
    return tokenizer, tuple(added)


def last_stable(text: str, low: int, high: int, added: Sequence[str] = ()) -> int | None:
    """The last place from ``low`` to before ``high`` where a token begins in any encoding that holds both neighbours."""
    at = None
    for m in BOUNDARY.finditer(text, low, min(len(text), high + 1)):
        place = m.start()
        if low <= place < high and not any(0 <= text.find(a, max(0, place - len(a) + 1), place + len(a) - 1) < place for a in added):
            at = place
    return at


def splice(text: str, encode: Callable[[str], Sequence[tuple[int, int]]], chunk: int = CHUNK, overlap: int = OVERLAP, added: Sequence[str] = ()) -> tuple[int, int]:
    """Tokens of ``text``, and how often an overlap had to be widened.

    ``encode`` gives the offsets of a text's tokens. The running count always stands at ``done``, a
    proven boundary; ``left`` holds the token starts of the encoding that begins there.
    """
    total, done, widened = 0, 0, 0
    end = min(len(text), chunk)
    left = [a for a, _ in encode(text[:end])]
    while end < len(text):
        reach, cut = overlap, None
        while True:
            begin = max(done, end - reach)
            if (cut := last_stable(text, begin + 1, end, added)) is not None or begin == done:
                break
            widened += 1
            reach *= 4
        if cut is not None:
            stop = min(len(text), end + chunk)
            right = [a + begin for a, _ in encode(text[begin:stop])]
            if cut in set(left) and cut in set(right):
                total += sum(a < cut for a in left)
                left, done, end = [a for a in right if a >= cut], cut, stop
                continue
            widened += 1
        # Nothing aligns since the last splice: a longer chunk from there on.
        end = min(len(text), done + 4 * (end - done))
        left = [a + done for a, _ in encode(text[done:end])]
    return total + len(left), widened


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts. Texts of one chunk are encoded together."""
    tokenizer, added = load(path)

    def offsets(text: str) -> Sequence[tuple[int, int]]:
        return tokenizer.encode(text, add_special_tokens=False).offsets

    def count(texts: list[str]) -> list[int]:
        single = [t for t in texts if len(t) <= chunk]
        counts = map(len, tokenizer.encode_batch_fast(single, add_special_tokens=False))
        return [next(counts) if len(t) <= chunk else splice(t, offsets, chunk, overlap, added)[0] for t in texts]

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_tokens and over_limit.

    One pass over the texts; there is no shuffle.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = counter(path, chunk, overlap)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = count(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[key, "n_bytes", "n_tokens"])

        return work

    whole = F.coalesce(docs[text], F.lit(""))
    slim = docs.select(docs[key].alias(key), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    kind = slim.schema[key].dataType.simpleString()
    out = shared.arrow_map(slim, f"{key} {kind}, n_bytes long, n_tokens long", make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
