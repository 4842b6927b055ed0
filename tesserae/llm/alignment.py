"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode a blank and the text. Where tokens of both end at the same byte, the text is cut
into *groups*; tokens of the two whose byte ranges overlap are *linked*. The number of links that hold a
pair of ids, over the whole corpus, says how well the ids fit each other.

How it runs.

1. ``mapInPandas`` walks a block of documents of bounded size. A text is cut into units before blanks
   that follow another character; there tokens of both tokenizers end (below), so groups and links are
   those of the units, and each different unit is encoded and merged once: two pointers pass through the
   cumulative ends of its tokens, for many units in one array. The block puts out a row per document (counts, digest of the groups,
   its units by number), one of its units' pairs, and a row per different pair with its links.
2. Spark sums the links of each pair, and takes the highest sum of each id of either side.
3. Each block asks for the sums of the pairs it holds by a shuffled join on the pair; the answers come
   back to the block, where ``applyInArrow`` adds them up per document. So a frequent pair is asked for
   once per block, however many documents hold it.

Why units are independent. The byte-level tokenizer's expression ends every match that holds a
character other than white space before the next white space, so no token passes from such a character
to a blank. The other one merges pieces by rank; none of its pieces holds U+2581 after another
character (``load`` checks that), so no merge passes such a place either. A blank without anything after
it is no cut. U+2581 itself in a text decodes as a blank, which changes bytes: such a text has no tokens.

Odd rows: null and empty texts have no tokens: counts are zero, the digest is ''. So do texts whose
tokens, joined, differ from the blank and text. Repeated rows are aligned one by one, a null doc_id is
kept. A long text makes a block of its own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .token_counts import ODD, PLAIN

#: Bytes of text that make a block.
BLOCK = 8_000_000
#: Units met of late that a process remembers, and as many from before them.
MEMO = 150_000
#: Ids of the second tokenizer are below this, so that a pair is one number.
SHIFT = 1 << 24

CUT = re.compile(f"(?<=[^{PLAIN}{ODD}])(?=\x20.)", re.DOTALL)


def _bytes_of_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Two tokenizers, and what was found out about units so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            told = json.load(file)
        before = told.get("pre_tokenizer") or {}
        if (told["model"]["type"], before.get("type"), before.get("use_regex", True), told.get("normalizer")) != ("BPE", "ByteLevel", True, None):
            raise ValueError("the first tokenizer must be a byte-level BPE with the usual expression and no normaliser")
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        letters = _bytes_of_letters()
        size = 1 + max(self.a.get_vocab(with_added_tokens=True).values())
        parts = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            if token not in special:
                parts[i] = bytes(letters[c] for c in token)
        self.bytes_a = Strings(parts)
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds U+2581 after another character, so blanks are no sure boundaries")
        if len(pieces) >= SHIFT:
            raise ValueError(f"the second tokenizer has {SHIFT} pieces or more")
        self.bytes_b = Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = Strings([str(i).encode() for i in range(max(size, len(pieces)))])
        #: What is known of units: those met of late, and those of the time before.
        self.fresh: dict[str, Known | None] = {}
        self.stale: dict[str, Known | None] = {}

    def known(self, units: list[str]) -> list[Known | None]:
        """Alignments of units; ``None`` where bytes differ. Units that are not met again are forgotten."""
        out = [self.fresh.get(u, self) for u in units]
        new = []
        for i, unit in enumerate(units):
            if out[i] is self:
                if unit in self.stale:
                    out[i] = self.fresh[unit] = self.stale[unit]
                else:
                    new.append(i)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for i, found in zip(some, self.aligned([units[i] for i in some]), strict=True):
                out[i] = self.fresh[units[i]] = found
        if len(self.fresh) > MEMO:
            self.fresh, self.stale = {}, self.fresh
        return out

    def aligned(self, units: list[str]) -> list[Known | None]:
        """Tokens of either side, groups, the groups as text, and the linked pairs of each unit.

        All units stand behind one another, so the cumulative ends of either side rise and are merged at once.
        """
        ids = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)], self.b.encode([u[1:] for u in units], num_threads=1)
        text = [u.encode() for u in units]
        size = np.array([len(t) for t in text])
        counts = [np.array([len(x) for x in side]) for side in ids]
        flat = [np.fromiter((i for x in side for i in x), np.int64, int(n.sum())) for side, n in zip(ids, counts, strict=True)]
        owner = [np.repeat(np.arange(len(units)), n) for n in counts]
        fine = np.ones(len(units), bool)
        for table, token, unit in zip((self.bytes_a, self.bytes_b), flat, owner, strict=True):
            fine &= np.bincount(unit, table.size[token], len(units)) == size
        whole = np.frombuffer(b"".join(text), np.uint8)
        for table, token, unit in zip((self.bytes_a, self.bytes_b), flat, owner, strict=True):
            keep = fine[unit]
            same = table.joined(token[keep]) == whole[np.repeat(fine, size)]
            wrong = np.repeat(np.flatnonzero(fine), size[fine])[~same]
            fine[wrong] = False
        (a, b), (n_a, n_b) = flat, counts
        kept = [fine[unit] for unit in owner]
        a, b, owner_a, owner_b = a[kept[0]], b[kept[1]], owner[0][kept[0]], owner[1][kept[1]]
        ends_a, ends_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
        i, k, both = merged(ends_a, ends_b)
        pairs = a[i] * SHIFT + b[k]
        group_a, group_b = np.searchsorted(both, ends_a, "left"), np.searchsorted(both, ends_b, "left")
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        side = np.concatenate([2 * group_a, 2 * group_b + 1])[order]
        step = np.diff(side, append=side[-1:] + 2)
        mark = np.where(step == 0, ord(","), np.where((step == 1) & (side % 2 == 0), ord("|"), ord(";"))).astype(np.uint8)
        told, told_ends = self.digits.marked(np.concatenate([a, b])[order], mark)
        unit = np.concatenate([owner_a, owner_b])[order]
        edge = np.searchsorted(unit, np.arange(len(units) + 1))
        places = np.concatenate([[0], told_ends])[edge]
        links = np.concatenate([[0], np.cumsum(np.bincount(owner_a[i], minlength=len(units)))]).astype(np.int64)
        groups = np.bincount(np.searchsorted(np.cumsum(size * fine), both, "left"), minlength=len(units))
        held, linked = told.tobytes(), pairs.tobytes()
        return [
            (int(n_a[u]), int(n_b[u]), int(groups[u]), held[places[u] : places[u + 1] - 1], linked[8 * links[u] : 8 * links[u + 1]]) if fine[u] else None
            for u in range(len(units))
        ]


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both pointers at each step of a two-pointer merge of cumulative ends, and the ends that both sides share.

    From one end to the next of either side the pointers rest on one token each, whose ranges overlap there,
    and no other step has the two again: the steps are the links. The stable sort of two rising runs merges them.
    """
    ends = np.concatenate([ends_a, ends_b])
    order = np.argsort(ends, kind="stable")
    ends, of_a = ends[order], order < len(ends_a)
    step = np.diff(ends, prepend=-1) != 0
    passed = np.cumsum(of_a) - of_a
    return passed[step], (np.arange(len(ends)) - passed)[step], ends[~step]


#: Tokens of either side, groups, the groups as text, and the linked pairs as bytes.
Known = tuple[int, int, int, bytes, bytes]


class Strings:
    """Byte strings by number, joined for many numbers at once."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.held = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.held[np.repeat(self.at[numbers] - (ends - size), size) + np.arange(int(size.sum()))]

    def marked(self, numbers: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings, each followed by its mark, and where each ends."""
        size = self.size[numbers]
        ends = np.cumsum(size + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = marks
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        out[inner] = self.joined(numbers)
        return out, ends


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Aligner:
    """The aligner of two tokenizer files, once per Python process."""
    return Aligner(path_a, path_b)


def units_of(text: str) -> list[str]:
    """A blank and the text, cut where tokens of both tokenizers end; none if the text is empty."""
    return CUT.split(" " + text) if text else []


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 31, compressed, after their count."""
    return len(numbers).to_bytes(8, "little") + pa.compress(numbers.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes) -> np.ndarray:
    n = int.from_bytes(held[:8], "little")
    return np.frombuffer(pa.decompress(held[8:], 4 * n, codec="zstd", asbytes=True), "<i4")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, empty ones included."""
    whole = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return whole[ends[1:]] - whole[ends[:-1]]


#: What a block puts out, one kind of row for each of: documents, the block's units, its pairs.
WALKED = (
    "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "units binary, links binary, ends binary, pair long, n long"
)


def _walk(docs: DataFrame, path_a: str, path_b: str, whole: bool) -> DataFrame:
    columns = [c.split()[0] for c in WALKED.split(", ")]

    def block(number: int, rows: list[tuple[object, str]]) -> Iterator[pd.DataFrame]:
        aligner = load(path_a, path_b)
        numbers: dict[str, int] = {}
        cut = [[numbers.setdefault(u, len(numbers)) for u in units_of(text)] for _, text in rows]
        names = list(numbers)
        known = aligner.known(names)
        fine = np.array([k is not None for k in known], bool)
        count = np.array([k[:3] + (len(k[4]) // 8,) if k else (0, 0, 0, 0) for k in known], np.int64).reshape(-1, 4)
        told = [k[3] if k else b"" for k in known]
        links = np.frombuffer(b"".join([k[4] if k else b"" for k in known]), np.int64)
        times = np.zeros(len(names), np.int64)
        out = []
        for place, ((doc, _), units) in enumerate(zip(rows, cut, strict=True)):
            at = np.array(units, np.int64)
            if not len(at) or not fine[at].all():
                at = at[:0]
                out.append((place, doc, 0, 0, 0, 0, "", "", _packed(at)))
                continue
            np.add.at(times, at, 1)
            groups = b";".join([told[u] for u in units])
            out.append((place, doc, *count[at].sum(0).tolist(), hashlib.sha256(groups).hexdigest(), groups.decode() if whole else "", _packed(at)))
        frame = pd.DataFrame(out, columns=["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "units"])
        frame["doc_id"] = pd.array([d for d, _ in rows], "Int64")
        yield _filled(frame, number, columns)
        pairs, at = np.unique(links, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, at, np.repeat(times, count[:, 3]))
        yield _filled(pd.DataFrame({"links": [_packed(at)], "ends": [_packed(np.concatenate([[0], np.cumsum(count[:, 3])]))]}), number, columns)
        for i in range(0, len(pairs), 100_000):
            yield _filled(pd.DataFrame({"place": np.arange(i, min(i + 100_000, len(pairs)), dtype=np.int32), "pair": pairs[i : i + 100_000], "n": n[i : i + 100_000]}), number, columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                held.append((None if pd.isna(doc) else int(doc), text))
                size += len(text)
                if size >= BLOCK:
                    yield from block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield from block(number, held)

    # As text, a doc_id keeps its digits beside nulls.
    slim = shared.document_columns(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared.small_batches(docs.sparkSession, 500)
    return slim.mapInPandas(run, WALKED)


def _filled(frame: pd.DataFrame, block: int, columns: list[str]) -> pd.DataFrame:
    """``frame`` with all columns, those that it lacks as null."""
    for c in columns:
        if c not in frame:
            frame[c] = pd.array([pd.NA] * len(frame), "Int64") if c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "pair", "n", "place") else None
    frame["block"] = block
    return frame[columns]


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Per pair of ids its links, and the highest number of links of either id: pair, a, b, count, most_a, most_b."""
    summed = pairs.groupBy("pair").agg(F.sum("n").alias("count")).where("count > 0")
    sides = summed.withColumns({"a": F.floor(F.col("pair") / SHIFT).cast("long"), "b": F.pmod("pair", F.lit(SHIFT)).cast("long")})
    # An id of one side has as many rows as the other side has ids at most, a bound of the vocabularies.
    most = {s: F.max("count").over(Window.partitionBy(s)) for s in ("a", "b")}
    return sides.withColumns({"most_a": most["a"], "most_b": most["b"]})


def align_tokens(docs: DataFrame, path_a: str, path_b: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per document its counts and digest (with ``whole`` also its groups as text), and the table of pairs."""
    walked = shared.stored(_walk(docs, path_a, path_b, whole), "aligned", even=False)
    pairs = walked.where("pair is not null").select("block", "place", "pair", "n")
    counts = shared.stored(pair_counts(pairs), "pair-counts")
    answers = pairs.where("n > 0").join(counts.select("pair", "count", (F.col("count") == F.col("most_b")).alias("best")), "pair").select("block", "place", "count", "best")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    again = walked.where("pair is null").select("block", "place", *kept, "units", "links", "ends")
    blocks = again.select(*[F.col(c).alias(c) for c in again.columns])  # columns of its own: the answers come from the same table
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"

    def back(rows: pa.Table, told: pa.Table) -> pa.Table:
        own = rows.filter(pc.is_valid(rows.column("place")))
        links = rows.filter(pc.is_valid(rows.column("links")))
        where, ends = (_unpacked(links.column(c)[0].as_py()) for c in ("links", "ends"))
        size = int(where.max()) + 1 if len(where) else 0
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = told.column("place").to_numpy()
        count[at], best[at] = told.column("count").to_numpy(), told.column("best").to_numpy().astype(np.int64)
        per_unit = np.stack([_sums(best[where], ends), _sums(count[where], ends)], 1) if len(ends) > 1 else np.zeros((0, 2), np.int64)
        sums = [per_unit[_unpacked(u)].sum(0).tolist() for u in own.column("units").to_pylist()]
        out = own.select(kept)
        out = out.append_column("n_best", pa.array([int(s[0]) for s in sums], pa.int64()))
        return out.append_column("count_sum", pa.array([int(s[1]) for s in sums], pa.int64()))

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(back, schema)
    return (out if whole else out.drop("groups")), counts
