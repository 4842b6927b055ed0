"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and underscores in lower case; characters of scripts that are
written without spaces are tokens of their own. Every seed is a mask over a run of
tokens; its hash ignores the positions that the mask leaves out, so a substituted token there does
no harm. Hashes of the texts are looked up among those of the benchmark, and around each hit the two
are aligned and compared token by token: an item overlaps a text where some window of ``window``
tokens of the item (all of it, if it is shorter) agrees in at least ``agree`` of its positions.

The default window of 16 tokens of which 13 agree also takes in every run of 13 equal tokens.

The seeds in ``MASKS`` meet every window of 20 tokens with up to 4 substitutions, of 15 with 3 and of
10 with 2, wherever they are, and those in ``SHORT`` every item of 5, 6 or 7 tokens with one (tests
try all), so with the defaults nothing is missed. Items of fewer than ``LEAST`` tokens must occur
as they are, token for token; a hash of the whole item finds them.

Hits are expanded, made distinct and compared in blocks of ``PAIRS`` rows of numbers, so a phrase
that many items share costs a few bytes per item and hit, and memory stays bounded.

The benchmark is taken in blocks of at most ``BLOCK`` characters, each of which is broadcast and met
by one pass over the texts; one block does for all but the largest benchmarks.

Null and empty texts and items have no tokens. Repeated rows, texts or items, are found each by
each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MASKS = ("11111", "1100111", "101010011")
#: Masks of short items, by their number of tokens.
SHORT = {5: "11", 6: "111", 7: "111"}
WINDOW, AGREE, LEAST, BLOCK = 16, 0.8, 5, 16_000_000
#: Hits, and compared tokens, that are held as numbers at once.
PAIRS = 1_000_000
#: Thai, Lao, Burmese, Khmer, kana and Han: scripts written without spaces (fixed values).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
TOKEN = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every run of ``ids`` under a mask; an id of 0 makes no difference to its neighbours."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    wide = ids.astype(np.uint64)
    for f, at in zip(_FACTOR[: mask.count("1")], (i for i, c in enumerate(mask) if c == "1"), strict=True):
        out += wide[at : at + n] * f
    return out ^ (out >> np.uint64(29))


def cared(known: np.ndarray, mask: str) -> np.ndarray:
    """Where all positions that a mask looks at hold known tokens."""
    n = max(0, len(known) - len(mask) + 1)
    out = np.ones(n, bool)
    for at, c in enumerate(mask):
        if c == "1":
            out &= known[at : at + n]
    return out


class Index:
    """Seeds of the benchmark items, and the comparison around hits."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE):
        self.vocab: dict[str, int] = {}
        told = [(i, tokens(t)) for i, t in items]
        told = [(i, w) for i, w in told if w]
        self.items = [i for i, _ in told]
        ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64) for _, ws in told]
        self.ids, self.window, self.agree = ids, window, agree
        # A mask serves the items that are given it: short ones one of theirs, the others those of ``masks``.
        serve = {m: [] for m in (*masks, *SHORT.values(), *("1" * k for k in range(1, LEAST)))}
        for k, x in enumerate(ids):
            for m in {*masks, SHORT.get(len(x), masks[0])} if len(x) >= LEAST else {"1" * len(x)}:
                serve[m].append(k)
        self.masks = tuple(m for m, items in serve.items() if items)
        self.size = np.array([len(x) for x in ids], np.int64)
        self.begin = np.append(0, self.size.cumsum())[:-1].astype(np.int64)
        self.flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.tables = []
        for mask in self.masks:
            mine = set(serve[mask])
            hashes = [seeds(x, mask) if k in mine else np.zeros(0, np.uint64) for k, x in enumerate(ids)]
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
            order = np.argsort(flat, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(flat >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((flat[order], item[order], place[order], bits))
        self.pad = max(map(len, self.masks), default=1)

    def encode(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """Overlaps (text, item, agreeing tokens, item tokens, first token of the item in the text)."""
        coded = [self.encode(t) for t in texts]
        # All texts of a slice end to end, with unknown tokens between them so that no seed spans two.
        gap = np.zeros(self.pad, np.int64)
        flat = np.concatenate([x for c in coded for x in (c, gap)]) if coded else gap
        starts = np.append(0, np.cumsum([len(c) + self.pad for c in coded]))[:-1]
        known = flat > 0
        sizes = np.array([len(c) for c in coded], np.int64)
        pairs: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        held = 0
        for mask, (hashes, item, place, bits) in zip(self.masks, self.tables, strict=True):
            at = np.flatnonzero(cared(known, mask))
            h = seeds(flat, mask)[at]
            maybe = bits[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            text = np.searchsorted(starts, at, "right") - 1
            for k, j in spread(high - low, low, PAIRS):
                met = np.stack([text[k], item[j], at[k] - starts[text[k]] - place[j]], axis=1)
                pairs.append(distinct(met))
                held += len(pairs[-1])
                if held > PAIRS:  # one diagonal is met by many seeds: keep the distinct ones
                    pairs = [distinct(np.concatenate(pairs))]
                    held = -len(pairs[0])
        found = [np.zeros((0, 4), np.int64)]
        rows = distinct(np.concatenate(pairs))
        cost = self.size[rows[:, 1]].cumsum()
        cuts = np.searchsorted(cost, np.arange(PAIRS, int(cost[-1]) + 1, PAIRS)) if len(cost) else []
        for some in np.split(rows, cuts):
            agreeing, enough = self.compare(some, flat, starts, sizes)
            found.append(np.column_stack([some, agreeing])[enough])
        best = np.concatenate(found)
        best = best[np.lexsort((best[:, 2], -best[:, 3], best[:, 1], best[:, 0]))]
        first = np.r_[True, (best[1:, :2] != best[:-1, :2]).any(axis=1)][: len(best)]
        return [(t, i, n, int(self.size[i]), shift) for t, i, shift, n in best[first].tolist()]

    def compare(self, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows (text, item, shift): how many tokens agree, and whether some window of the item agrees enough."""
        text, item, shift = rows.T
        n = self.size[item]
        end = n.cumsum()
        place = np.arange(int(n.sum())) - np.repeat(end - n, n)
        at = place + np.repeat(shift, n)
        inside = (at >= 0) & (at < np.repeat(sizes[text], n))
        there = flat[np.where(inside, at + np.repeat(starts[text], n), 0)]
        equal = inside & (self.flat[place + np.repeat(self.begin[item], n)] == there)
        total = np.append(0, equal.cumsum())
        window = np.minimum(self.window, n)
        # The window that ends behind each place, where it lies within the item.
        whole = place + 1 >= np.repeat(window, n)
        span = np.repeat(window, n)
        upto = np.arange(1, len(place) + 1)
        good = whole & (total[upto] - total[np.where(whole, upto - span, 0)] >= np.repeat(np.where(n < LEAST, 1.0, self.agree) * window, n))
        most = np.logical_or.reduceat(good, end - n) if len(n) else np.zeros(0, bool)
        return total[end] - total[end - n], most


def spread(count: np.ndarray, low: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row and each of ``count`` numbers from ``low`` on, in blocks of about ``most``."""
    rows = np.flatnonzero(count)
    total = np.append(0, count[rows].cumsum())
    at = 0
    while at < total[-1]:
        to = min(at + most, int(total[-1]))
        each = np.arange(at, to)
        k = np.searchsorted(total, each, "right") - 1
        yield rows[k], low[rows[k]] + each - total[k]
        at = to


def distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct rows (text, item, shift), in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][: len(rows)]]


def blocks(benchmark: DataFrame, block: int = BLOCK, masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE):
    """An index for each block of the benchmark; how many there are follows from its measured size."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + int(2 * size // block)
    for k in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k)
        yield Index([(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect()], masks, window, agree)


def overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, item_id, agreeing, item_tokens, at) for each text and item that overlap."""
    spark, out = docs.sparkSession, None
    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    for index in blocks(benchmark, **options):
        sent = spark.sparkContext.broadcast(index)

        def make(sent=sent) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            index = sent.value

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = index.find(batch.column(1).to_pylist())
                cols = list(zip(*found, strict=True)) or [[]] * 5
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([index.items[i] for i in cols[1]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["doc_id", "item_id", "agreeing", "item_tokens", "at"],
                )

            return work

        part = shared.arrow_map(slim, f"doc_id {kind}, item_id long, agreeing long, item_tokens long, at long", make)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, as they are, whose text overlaps no item."""
    spark, out = docs.sparkSession, docs
    place = docs.columns.index("text")
    for index in blocks(benchmark, **options):
        sent = spark.sparkContext.broadcast(index)

        def make(sent=sent) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            index = sent.value

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in index.find(batch.column(place).to_pylist())]] = False
                return batch.filter(pa.array(keep))

            return work

        out = shared.arrow_map(out, shared.ddl(docs), make, text=place)
    return out
