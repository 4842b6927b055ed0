"""Texts that are similar letter by letter, found over a whole corpus without comparing all pairs.

The similarity of two texts is twice their longest common subsequence over both lengths, in percent
(``ratio``). A pair at ``least`` percent is at most D = (1 - least/100) * (both lengths) single-letter
insertions and deletions apart.

``similar_pairs`` is lossless. Texts are dealt to blocks by length, and two blocks meet in one task if a text of one
can be a partner of a text of the other: the longer is at most (2 - t) / t times as long, t = least/100. A task holds two blocks
of ``BYTES`` of letters at most (or two longer texts), whose pairs pass four tests, each of which a pair with D edits passes always:

1. The letter pairs that two texts share, counted by bucket, are at most the sum of the roots of the products of the counts:
   a product of matrices for many texts at once.
2. Of the q-letter grams of a text, each deletion spoils q at most and each insertion q - 1. Up to ``SKETCHED`` letters they are counted
   by bucket in the same way, with more buckets than letters, for the texts that the first test leaves to each other.
3. Of the even segments of the longer text an edit spoils one; the others stand in the shorter text, at places whose shifts
   to the left and the right come to D at most. They are looked up in a map of the shorter text's grams by zone, then exactly.
4. The letters that two texts share, in any order, are no fewer than their common subsequence.

What is left is compared exactly (``_reaches``), within the places that D edits can shift and until too many letters are left out, in the
task that has the texts, so neither places nor pairs of texts are shuffled: what is shuffled is each text, once for each block that its
own one meets. The products of matrices are quadratic within the bounds of length.

``clusters`` first links texts that share a least-hash key to the least text with that key, which
joins most copies in one group by few comparisons, and then looks for pairs across groups only. No
link between groups is lost; links inside a group are not needed for it, nor a link that others of the same task imply.

Long texts of one small vocabulary share nearly all grams and come to the third test.

Null texts are left out; equal texts are one in pairs and stand together in clusters; an empty text
is like itself alone. Repeated keys count as one row with several texts. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import kept

#: Letters of a block on average (a longer text is a block of its own), and classes of length within one reach of partners.
BYTES, CLASSES = 32 << 20, 2
#: Buckets of letter pairs, rows of a block that are compared at a time, and letters of texts whose longer grams are counted.
BUCKETS, ROWS, SKETCHED = 256, 1_024, 6_400
#: Least-hash keys per text and letters of what they hash.
KEYS, SHINGLE = 6, 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(letters: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the ``q`` letters from each place on."""
    if len(letters) < q:
        return np.zeros(0, np.uint64)
    out = np.full(len(letters) - q + 1, q, np.uint64)
    for j in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + letters[j : len(letters) - q + 1 + j] + np.uint64(1)
    return _mix(out)


class Plan:
    """Numbers that follow from the percentage and a text's length as the shorter one."""

    def __init__(self, least: float):
        self.t = least / 100
        if not 2 / 3 < self.t <= 1:
            raise ValueError("similarities of over 200/3 to 100 percent can be indexed")
        self.base = min(16, max(1, round(0.6 * self.t / (2 - 2 * self.t)))) if self.t < 1 else 16

    def edits(self, both: np.ndarray | int) -> np.ndarray | int:
        """Insertions and deletions between texts of these lengths together."""
        return np.floor((1 - self.t) * both + 1e-9).astype(np.int64) if isinstance(both, np.ndarray) else int((1 - self.t) * both + 1e-9)

    def most(self, m: np.ndarray) -> np.ndarray:
        """Edits to the longest partner of a text of length ``m``."""
        return self.edits(m + np.floor(m * (2 - self.t) / self.t + 1e-9).astype(np.int64))

    def size(self, m: np.ndarray) -> np.ndarray:
        """Letters of a segment."""
        most = self.most(m)
        return np.where(m // self.base > most, self.base, np.maximum(1, m // (most + 1)))

    def gram(self, m: int) -> int:
        """Letters of the grams that tell texts of about this length apart; any number loses no pair."""
        return max(1, min(4 if m < 1_400 else 5 if m < 3_000 else 6, 6 if self.t > 0.93 else 3 if self.t > 0.88 else 2))

    def step(self) -> float:
        """Logarithm of the width of a class of length."""
        return max(1e-3, float(np.log((2 - self.t) / self.t))) * (1 + 1e-6) / CLASSES


def _classes(texts: DataFrame, least: float) -> DataFrame:
    """(k, t, c, part, of): class of length and part of it, where ``of`` is the number of the class's parts."""
    placed = texts.where("t <> ''").withColumn("cls", F.floor(F.log(F.length("t").cast("double")) / Plan(least).step()).cast("int"))
    sizes = placed.groupBy("cls").agg(F.ceil(F.sum(F.length("t") + 200) / F.lit(float(BYTES))).cast("int").alias("of"))
    return placed.join(F.broadcast(sizes), "cls").withColumn("part", F.pmod(F.xxhash64("k"), F.col("of")).cast("int"))  # one row per class


def _meetings(texts: DataFrame, least: float) -> DataFrame:
    """Rows of the blocks that meet: (i, j) is the shorter class and its part, (x, y) the longer one; ``b`` tells whose the row is."""
    placed = _classes(texts, least)
    blocks = kept(placed.select("cls", "part").distinct(), "blocks")
    low, high = blocks.select(F.col("cls").alias("i"), F.col("part").alias("j")), blocks.select(F.col("cls").alias("x"), F.col("part").alias("y"))
    met = low.join(F.broadcast(high), (F.col("x") >= F.col("i")) & (F.col("x") <= F.col("i") + CLASSES) & ((F.col("x") > F.col("i")) | (F.col("y") >= F.col("j"))))
    pairs = kept(met, "meetings")  # numbers of blocks, a few per BYTES of input
    one = placed.join(F.broadcast(pairs), (F.col("cls") == F.col("i")) & (F.col("part") == F.col("j"))).select("i", "j", "x", "y", F.lit(0).alias("b"), "k", "c", "t")
    two = placed.join(F.broadcast(pairs.where("i <> x OR j <> y")), (F.col("cls") == F.col("x")) & (F.col("part") == F.col("y")))
    both = one.union(two.select("i", "j", "x", "y", F.lit(1).alias("b"), "k", "c", "t"))
    # Spark does not lower a number that it is given: tasks of few bytes and much work stay apart.
    return both.repartition(max(1, min(1_000, pairs.count())), "i", "j", "x", "y")


def _counts(letters: np.ndarray, q: int, buckets: int) -> np.ndarray:
    """Grams by bucket."""
    return np.bincount((_grams(letters, q) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)


class _Groups:
    """Union of groups by their numbers; the least one names a union."""

    def __init__(self):
        self.over: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.over.get(x, x)) != x:
            self.over[x] = self.over.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.over[max(x, y)] = min(x, y)


class _Block:
    def __init__(self, keys: list[int], groups: list[int], texts: list[str]):
        order = sorted(range(len(keys)), key=lambda i: (len(texts[i]), keys[i]))
        self.k, self.c, self.t = ([column[i] for i in order] for column in (keys, groups, texts))
        self.key, self.n, self.group = np.array(self.k, np.int64), np.array([len(t) for t in self.t], np.int64), np.array(self.c, np.int64)
        self.roots = np.zeros((len(self.t), BUCKETS), np.float32)
        for i, t in enumerate(self.t):
            self.roots[i] = np.sqrt(_counts(_letters(t), 2, BUCKETS))
        self.made: dict[tuple, object] = {}

    def sketch(self, q: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of grams by bucket, and the texts with a count that has no room."""
        if (q, buckets) not in self.made:
            counts, over = np.zeros((len(self.t), buckets), np.uint8), np.zeros(len(self.t), bool)
            for i, t in enumerate(self.t):
                found = _counts(_letters(t), q, buckets)
                counts[i], over[i] = np.minimum(found, 255), found.max() > 255
            self.made[q, buckets] = counts, over
        return self.made[q, buckets]

    def zoned(self, i: int, size: int, width: int, bits: int) -> np.ndarray:
        """Where the segments of a text stand in the map of a text that has them in their zones."""
        if (i, size, width, bits) not in self.made:
            n = len(self.t[i]) // size
            g = _segments(_letters(self.t[i])[: n * size], size)
            self.made[i, size, width, bits] = _zone(g, np.arange(n) * size // width, bits)
        return self.made[i, size, width, bits]


#: Roots of counts.
ROOTS = np.sqrt(np.arange(256)).astype(np.float32)


def _rectangles(ok: np.ndarray, most: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, in groups that have most columns in common, and all columns of each group; every row with a column is in one group."""
    left = np.flatnonzero(ok.any(axis=1))
    for last in range(most):
        if not len(left):
            return
        seed = ok[left[0]]
        near = (ok[left] & seed).sum(axis=1) * 2 > min(seed.sum(), len(seed) // 2) if last < most - 1 else np.ones(len(left), bool)
        near[0] = True
        yield left[near], np.flatnonzero(ok[left[near]].any(axis=0))
        left = left[~near]


def _passed(one: _Block, two: _Block, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the texts of one block and of those of the other, no shorter ones, that pass the first two tests."""
    plan, same = Plan(least), one is two
    if not one.t or not two.t:
        return
    short = two.n[-1] <= SKETCHED
    q, buckets = plan.gram(int(one.n[0])), max(64, 1 << int(1.85 * two.n[-1]).bit_length())
    # Grams that the shorter text may lose, over its length and the longer one's: (q - 1) * D, and half of D less the difference.
    slope = lambda q: ((q - 0.5) * (1 - plan.t) + 0.5, (q - 0.5) * (1 - plan.t) - 0.5)
    least_of = lambda q, m: ((1 - slope(q)[0]) * m - q - 1 - 1e-3 * m).astype(np.float32)
    more_of = lambda q, n: (slope(q)[1] * n).astype(np.float32)
    for cut in range(0, len(one.t), ROWS):
        rows = slice(cut, cut + ROWS)
        low, high = int(np.searchsorted(two.n, one.n[rows].min())), int(np.searchsorted(two.n, int(one.n[rows].max() * (2 - plan.t) / plan.t + 1), side="right"))
        for at in range(low, high, 4 * ROWS):
            cols = slice(at, min(high, at + 4 * ROWS))
            ok = one.roots[rows] @ two.roots[cols].T >= least_of(2, one.n[rows])[:, None] - more_of(2, two.n[cols])
            if short:
                (mine, over), (others, wide) = one.sketch(q, buckets), two.sketch(q, buckets)
                for r, c in _rectangles(ok):
                    left = ROOTS[mine[r + cut]]
                    for few in np.array_split(c, -(-len(c) // ROWS)):
                        good = left @ ROOTS[others[few + at]].T >= least_of(q, one.n[r + cut])[:, None] - more_of(q, two.n[few + at])
                        ok[np.ix_(r, few)] &= good | over[r + cut, None] | wide[None, few + at]
            for i in np.flatnonzero(ok.any(axis=1)):
                j = np.flatnonzero(ok[i]) + at
                m, n = one.n[cut + i], two.n[j]
                good = (n >= m) & (n - m <= plan.edits(m + n)) & (one.group[cut + i] != two.group[j])
                good &= (m < n) | (one.key[cut + i] < two.key[j]) if same else True
                if good.any():
                    yield cut + int(i), j[good]


#: Bits of a hash that stay beside a place, and texts too long for such places.
HIGH, FAR = np.uint64(0xFFFFFFFFFF000000), 1 << 24


def _segments(letters: np.ndarray, size: int) -> np.ndarray:
    """The grams that ``_grams`` has at each ``size``-th place, of letters that are so many segments."""
    out = np.full(len(letters) // size, size, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + letters[j::size] + np.uint64(1)
    return _mix(out)


def _zone(g: np.ndarray, zone: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(g + zone.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1)).astype(np.int64)


def _by_zone(a: _Block, i: int, b: _Block, places: list[int], least: float) -> list[int]:
    """The third test, by a map, for a text and texts that are no shorter: segments may stand in any place of a zone and those about it."""
    plan, m, top = Plan(least), int(a.n[i]), int(b.n[-1])
    both = plan.edits(m + b.n[places])
    size = plan.base + 2 if (b.n[places] // (plan.base + 2) > both * 1.1).all() else plan.base
    width, bits = max(64, int((1 - plan.t) * top)), 1 << (32 * top).bit_length()
    lost, new = int(both.max()) // 2 + 1, int((both + b.n[places] - m).max()) // 2 + 1
    g = _grams(_letters(a.t[i]), size)
    at = np.arange(len(g))
    first, last = np.maximum(0, at - lost) // width, (at + new) // width
    table = np.zeros(bits, bool)
    for more in range(int((last - first).max(initial=-1)) + 1):
        on = first + more <= last
        table[_zone(g[on], first[on] + more, bits)] = True
    return [j for j, d in zip(places, both.tolist(), strict=True) if b.n[j] // size - np.count_nonzero(table[b.zoned(j, size, width, bits)]) <= d]


def _standing(text: str, size: int) -> np.ndarray:
    """Hashes and places of all grams, in order."""
    g = _grams(_letters(text), size)
    return np.sort((g & HIGH) | np.arange(len(g), dtype=np.uint64))


def _in_place(standing: np.ndarray, text: str, size: int, edits: int, lost: int, new: int) -> bool:
    """Whether all but ``edits`` even segments of the longer text stand in the shorter one near their places."""
    n = len(text) // size
    g = _segments(_letters(text[: n * size]), size)
    at = np.arange(n) * size
    found = np.searchsorted(standing, (g & HIGH) | np.maximum(0, at - new).astype(np.uint64))
    held = np.append(standing, np.uint64(0))[found]
    hit = (held & HIGH == g & HIGH) & (found < len(standing)) & ((held & ~HIGH).astype(np.int64) <= at + lost)
    return n - int(hit.sum()) <= edits


def _near(a: str, b: str, least: float, known: dict[int, np.ndarray]) -> bool:
    """The third test for a text and one that is no shorter; ``known`` keeps what the first needs for all its partners."""
    plan = Plan(least)
    edits = plan.edits(len(a) + len(b))
    lost = (edits - (len(b) - len(a))) // 2
    if len(b) >= FAR:
        return True
    for size in (plan.base, plan.base + 2):
        if len(b) // size > edits:
            if size not in known:
                known[size] = _standing(a, size)
            if not _in_place(known[size], b, size, edits, lost, lost + len(b) - len(a)):
                return False
    return True


def _linked(texts: DataFrame, least: float, groups: DataFrame | None = None) -> DataFrame:
    """(u, v): pairs at ``least`` percent or more; with ``groups`` (k, c) pairs across them that join all that similarity joins."""
    if groups is None:
        named = texts.withColumn("c", F.col("k"))
    else:
        named = texts.join(groups, "k", "left").withColumn("c", F.coalesce("c", "k"))
    all_pairs = groups is None

    def meet(t: pa.Table) -> pa.Table:
        u, v, joined = [], [], _Groups()
        blocks = []
        for b in (0, 1):
            mine = t.filter(pc.equal(t.column("b"), b))
            blocks.append(_Block(*(mine.column(c).to_pylist() for c in ("k", "c", "t"))))
        one, two = blocks[0], blocks[1] if blocks[1].t else blocks[0]
        same_class = t.column("i")[0] == t.column("x")[0] and one is not two
        for a, b in ((one, two), (two, one)) if same_class else ((one, two),):
            for i, places in _passed(a, b, least):
                known: dict[int, np.ndarray] = {}
                if same_class and a is two:
                    places = places[b.n[places] > a.n[i]]  # equal lengths were met the first time
                near = [j for j in places.tolist() if all_pairs or joined.find(a.c[i]) != joined.find(b.c[j])]
                for j in _by_zone(a, i, b, near, least) if len(near) > 2 else near:
                    if not all_pairs and joined.find(a.c[i]) == joined.find(b.c[j]):
                        continue
                    if _near(a.t[i], b.t[j], least, known) and _similar(a.t[i], b.t[j], least):
                        u.append(a.k[i])
                        v.append(b.k[j])
                        joined.join(a.c[i], b.c[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return _meetings(named, least).groupBy("i", "j", "x", "y").applyInArrow(meet, "u long, v long")


def _stars(texts: DataFrame) -> DataFrame:
    """(u, v): texts and the least text that shares a least-hash key with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _mix(np.arange(1, KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            keys, out = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = _grams(_letters(text or ""), min(SHINGLE, max(1, len(text or ""))))
                if len(g):
                    out += [int(_mix(g ^ s).min()) for s in salts]
                    keys += [k] * KEYS
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(out, np.uint64).view(np.int64))], names=["k", "h"])

    hashed = texts.select("k", "t").mapInArrow(run, "k long, h long")
    first = hashed.groupBy("h").agg(F.min("k").alias("u"), F.count("*").alias("n")).where("n > 1").select("h", "u")
    return hashed.join(first, "h").where("k <> u").select("u", F.col("k").alias("v")).distinct()


def _trimmed(a: str, b: str) -> tuple[str, str, int]:
    """Both texts without the ends that they share, and the letters of these."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b, tail = a[head:], b[head:], 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return a[: len(a) - tail], b[: len(b) - tail], head + tail


def _places(text: str) -> dict[str, int]:
    """The places of each letter as bits."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {chr(c): int.from_bytes(np.packbits(letters == c, bitorder="little").tobytes(), "little") for c in np.unique(letters).tolist()}


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: equal ends aside, a bit vector at a time."""
    a, b, same = _trimmed(a, b)
    place = _places(a)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = row & place.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return same + len(a) - row.bit_count()


def _reaches(a: str, b: str, need: int) -> bool:
    """Whether ``b`` and a text that is no longer have ``need`` letters in common in their order.

    A letter of ``b`` is met by letters that stand at most as far before it as ``b`` may lose letters, and as far behind as ``a`` may,
    so a bit vector of these places is enough. It ends once a start of ``b`` has lost too many.
    """
    a, b, same = _trimmed(a, b)
    need -= same
    lost, new = len(a) - need, len(b) - need
    if need <= 0 or lost < 0:
        return need <= 0
    place, step = _places(a), max(64, (lost + new) // 2)
    row = low = high = found = before = 0
    for at in range(0, len(b), step):
        part = b[at : at + step]
        start, end = max(0, at - new), min(len(a), at + len(part) + lost)
        before += start - low - (row & ((1 << start - low) - 1)).bit_count()
        row = row >> start - low | (1 << end - high) - 1 << high - start
        low, high, full = start, end, (1 << end - start) - 1
        here = {c: place.get(c, 0) >> start & full for c in set(part)}
        for c in part:
            u = row & here[c]
            row = ((row + u) | (row - u)) & full
        found = before + end - start - row.bit_count()
        if at + len(part) - found > new:
            return False
    return found >= need


def ratio(a: str, b: str) -> float:
    """Similarity in percent: twice the common subsequence over both lengths."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def _similar(a: str, b: str, least: float) -> bool:
    if not a or not b:
        return a == b
    need = max(0, int(least * (len(a) + len(b)) / 200.0) - 1)
    while 200.0 * need / (len(a) + len(b)) < least:
        need += 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) >= need and sum((Counter(a) & Counter(b)).values()) >= need and _reaches(a, b, need)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose ratio is ``least`` percent or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(a, b, least) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.select(F.col("k").alias("u"), F.col("t").alias("a")), texts.select(F.col("k").alias("v"), F.col("t").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t): different texts, each with its least key."""
    return kept(df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.min(key).alias("k")).select("k", "t"), "texts")


def similar_pairs(df: DataFrame, least: float = 90.0, key: str = "_row_idx", text: str = "text") -> DataFrame:
    """(u, v), u < v: different texts, by their least keys, with a ratio of ``least`` percent or more; none is lost."""
    texts = _texts(df, key, text)
    found = _linked(texts, least)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(k, c): the least node that each node of ``links`` (u, v) is connected to.

    A round takes the least label of the neighbours and then that label's own label, so chains halve;
    every round is a written table.
    """
    both = kept(links.select("u", "v").union(links.select("v", "u")).distinct().toDF("u", "v"), "links")
    label = both.select(F.col("u").alias("k")).distinct().withColumn("c", F.col("k"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("k").alias("v"), F.col("c").alias("other")), "v").groupBy("u").agg(F.min("other").alias("low"))
        lower = label.join(near, label.k == near.u).select("k", "c", F.least("c", "low").alias("low"))
        jump = label.select(F.col("k").alias("low"), F.col("c").alias("far"))
        new = kept(lower.join(jump, "low").select("k", F.least("low", "far").alias("c"), (F.least("low", "far") < F.col("c")).alias("moved")), "labels")
        label = new.select("k", "c")
        if new.where("moved").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def clusters(df: DataFrame, least: float = 90.0, key: str = "_row_idx", text: str = "text") -> DataFrame:
    """(row, cluster): rows whose texts are linked by similarity; the cluster's least row names it."""
    texts = _texts(df, key, text)
    stars = kept(_verified(_stars(texts), texts, least), "stars")
    groups = components(stars)
    across = kept(_linked(texts, least, groups), "across")
    label = components(stars.union(across))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("row"), F.col(text).alias("t"))
    named = rows.groupBy("t").agg(F.min("row").alias("k"), F.count("*").alias("n")).join(label, "k", "left")
    linked = named.where("n > 1 OR c IS NOT NULL").select("t", F.coalesce("c", "k").alias("cluster"))
    return rows.join(linked, "t").select("row", "cluster")
