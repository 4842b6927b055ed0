"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints: word shingles are hashed with XXH64; a bit is set if it is set in over half of
   the hashes. A text without words has fingerprint zero and is linked like any other.
2. Only distinct fingerprints are linked, each with its least doc_id, so exact copies cost nothing.
3. Bits that vary together are put in the same part. With thresholds T_i >= -1 that sum to
   ``radius - parts + 1``, two fingerprints within the radius lie within T_i in some part i. Dynamic
   programming over candidate counts, estimated from a bounded sample, chooses the thresholds, and
   the cheapest number of parts wins.
4. Every fingerprint goes to the bucket of its own part value and, as a probe, to those within T_i
   bits. Buckets are verified by exact distance where they meet, and only a spanning forest of the
   links that were found leaves the task, never all pairs. A bucket of over ``cap`` fingerprints is
   cut into blocks whose pairs go to different tasks; no link is lost.
5. Components of the links give each document the least doc_id that it reaches.

Null and empty texts have no words. Rows that repeat a doc_id each get a row. Null doc_ids take part
but are no component_id unless a component has no other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components

SEED = 42
#: Fingerprints that the plan is estimated from at most, and that one bucket block holds at most.
SAMPLE, CAP = 4_000, 32_768
#: Costs in the plan: of dealing out one row, and of verifying one candidate.
ROW, PAIR = 40.0, 1.0


def shingles(text: str | None, width: int = 3) -> list[bytes]:
    """Shingles of the words of a text, A-Z in lower case, joined by one space."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, width)], dtype=">u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

        return work

    slim = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return shared.arrow_map(slim, "doc_id long, fp long", make)


# --- the plan ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """What to XOR into a part value to reach all values within the threshold, itself first."""
        return [sum(1 << b for b in c) for r in range(self.threshold + 1) for c in combinations(self.bits, r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grouped_bits(bits: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Greedy groups of correlated bits, equal in size within one; ``bits`` is (sample, 64)."""
    if len(bits) > 1:
        centred = bits - bits.mean(axis=0)
        spread = np.sqrt((centred**2).sum(axis=0))
        like = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-9)
    else:
        like = np.zeros((64, 64))
    free, out = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (like[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (like[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(tuple(sorted(group)))
    return out


def plan(sample: np.ndarray, total: int, radius: int) -> list[Part]:
    """Parts and thresholds of the least estimated cost for ``total`` fingerprints.

    ``sample`` holds signed fingerprints. The share of pairs within t bits in a part is counted on
    shifted pairs of the sample, plus that of uniform bits, so that it is never nought.
    """
    fps = np.sort(np.asarray(sample, dtype=np.int64).view(np.uint64))
    bits = ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    total = max(total, 1)  # an empty table must not make every plan cost nothing
    best: tuple[float, list[Part]] | None = None
    rng = np.random.default_rng(7)
    left, right = (rng.integers(0, max(1, len(fps)), 200_000) for _ in range(2))
    apart = (fps[left] ^ fps[right])[left != right] if len(fps) > 1 else np.zeros(0, np.uint64)
    for m in range(1, radius + 2):
        groups = grouped_bits(bits, m)
        most = min(radius, 3)
        cost: list[dict[int, float]] = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            near = np.bincount(np.bitwise_count(apart & mask), minlength=65).cumsum() / max(1, len(apart))
            options = {-1: 0.0}
            for t in range(min(most, len(g)) + 1):
                ball = sum(comb(len(g), r) for r in range(t + 1))
                share = near[t] + ball / 2.0 ** len(g)
                options[t] = ROW * total * ball + PAIR * share * total * total / 2
            cost.append(options)
        # table[s]: least cost of the parts so far with thresholds that sum to s.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for options in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t, more in options.items():
                    if s + t not in nxt or c + more < nxt[s + t][0]:
                        nxt[s + t] = (c + more, [*ts, t])
            table = nxt
        if (found := table.get(radius - m + 1)) and (best is None or found[0] < best[0]):
            best = (found[0], [Part(g, t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    assert best is not None
    return best[1]


# --- linking ----------------------------------------------------------------------------------


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index in each node's component, for edges a-b over n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def _large(fps: np.ndarray, own: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large bucket, its ``own`` rows first: one row against the rest at a time."""
    label = np.arange(len(fps))
    for i in range(own):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1
        if len(near) and (label[near] != label[i]).any():
            met = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, met)] = met[0]
    at = np.flatnonzero(label != np.arange(len(fps)))
    return at, label[at]


def bucket_links(keys: np.ndarray, fps: np.ndarray, probe: np.ndarray, radius: int, block: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) within each run of equal ``keys``; own rows come before probes in a run."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.append(starts[1:], n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = ends - starts
    for s, e in zip(starts[size > 512], ends[size > 512], strict=True):
        a, b = _large(fps[s:e], int((~probe[s:e]).sum()), radius)
        found.append((a + s, b + s))
    # The rest: every own row against those after it in its run, in blocks of pairs.
    stop = np.repeat(ends, size)
    rows = np.flatnonzero(~probe & (np.repeat(size, size) <= 512) & (stop - 1 > np.arange(n)))
    count = stop[rows] - rows - 1
    total = np.append(0, count.cumsum())
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, total[at] + block, side="right")) - 1)
        c = count[at:to]
        i = np.repeat(rows[at:to], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], c)
        hit = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        found.append((i[hit], j[hit]))
        at = to
    a, b = (np.concatenate(x) if found else np.zeros(0, int) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    uniq, inverse = np.unique(fps, return_inverse=True)
    label = roots(len(uniq), inverse[a], inverse[b])
    node = np.flatnonzero(label != np.arange(len(uniq)))
    return uniq[node], uniq[label[node]]


def _link_sorted(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, value, pair, probe, fp) sorted in that order to links (u, v); runs may span batches."""
    held: list[pa.RecordBatch] = []

    def give(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        part, value, pair, probe, fp = (c.to_numpy() for c in table.columns)
        keys = np.r_[0, ((part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])).cumsum()]
        u, v = bucket_links(keys, fp.view(np.uint64), probe.astype(bool), radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [c[-1].as_py() for c in batch.columns[:3]]
        same = np.logical_and.reduce([batch.column(k).to_numpy() == last[k] for k in range(3)])
        cut = int(same.argmax())  # rows from here on belong to a run that the next batch may go on with
        if cut == 0 and held and [c[-1].as_py() for c in held[-1].columns[:3]] == last:
            held.append(batch)
            continue
        if ready := [*held, batch.slice(0, cut)] if cut or held else []:
            yield give(ready)
        held = [batch.slice(cut)]
    if held:
        yield give(held)


def links(distinct: DataFrame, radius: int = 3, cap: int = CAP, sample: int = SAMPLE) -> DataFrame:
    """Links (u, v) that span every component of fingerprints at ``radius`` or fewer differing bits."""
    total = distinct.count()
    some = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64)
    parts = plan(some, total, radius)
    rows = F.array(*[
        F.struct(F.lit(k).cast("int").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(p.mask))).bitwiseXOR(F.lit(_signed(flip))).alias("value"), F.lit(int(flip != 0)).alias("probe"))
        for k, p in enumerate(parts) for flip in p.flips()
    ])
    dealt = distinct.select("fp", F.explode(rows).alias("r")).select("r.part", "r.value", "r.probe", "fp")
    sizes = dealt.groupBy("part", "value").count().where(F.col("count") > cap)
    hot = shared.stored(sizes, "hot")
    if hot.isEmpty():
        cut = dealt.withColumn("pair", F.lit(0))
    else:
        # Blocks of a large bucket meet pair by pair: row of block b goes to the pairs that hold b.
        blocks = hot.select("part", "value", F.ceil(F.col("count") / (cap // 2)).cast("int").alias("n"))
        b = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        pairs = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.least(o, b) * F.col("n") + F.greatest(o, b))
        )
        cut = dealt.join(blocks, ["part", "value"], "left").withColumn("pair", F.explode(pairs))
    keyed = cut.select("part", "value", "pair", "probe", "fp")
    ordered = keyed.repartition("part", "value", "pair").sortWithinPartitions("part", "value", "pair", "probe", "fp")
    return ordered.mapInArrow(lambda batches: _link_sorted(batches, radius), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, cap: int = CAP) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id."""
    prints = shared.stored(fingerprints(docs, width), "fingerprints")
    distinct = shared.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    joined = components(links(distinct, radius, cap))
    linked = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    reps = shared.stored(linked.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "rep"), "linked")
    # One row per component: a component of most texts is dealt to no single task while these are few.
    least = shared.stored(reps.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
    placed = reps.join(shared.small(least, least.count()), "root").select("node", "component_id")
    named = distinct.join(placed, F.col("node") == F.col("fp"), "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- one document of each group -----------------------------------------------------------------

#: Bits that SimHash candidates may differ in, words of a shingle and similarity of what counts as a copy.
RADIUS, WIDTH, SIMILAR, MEMBERS = 8, 5, 0.8, 4096
#: Shingle hashes that the texts of one candidate group, or of two blocks of it, hold at most on average: 32 MB.
HASHES = 4_000_000
#: MinHash bands of a text, and the hashes in each: two texts of Jaccard similarity J meet in none of the
#: bands with a chance of (1 - J**6)**24, which is 0.0007 at 0.8 and less above.
BANDS, ROWS = 24, 6
_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_TIMES |= np.uint64(1)


def gram_hashes(text: str | None, width: int) -> np.ndarray:
    """The set of 64-bit shingle hashes of a text, sorted as signed integers."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles(text, width)], np.uint64).view(np.int64))


def bands(grams: np.ndarray) -> np.ndarray:
    """The MinHash bands of a set of shingle hashes; none for a text without words."""
    if not len(grams):
        return np.zeros(0, np.int64)
    wide = grams.view(np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(wide), 2048):
        np.minimum(least, (wide[i : i + 2048] * _TIMES + _PLUS).min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def band_links(texts: DataFrame) -> DataFrame:
    """Links (u, v) of the fingerprints of texts (fp, bands) that share a band, each to the band's least."""
    rows = texts.select("fp", F.explode("bands").alias("band"))
    least = rows.groupBy("band").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").select("band", "v")
    return rows.join(least, "band").where("fp > v").select(F.col("fp").alias("u"), "v")


def similar_links(node: np.ndarray, block: np.ndarray, grams: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that span the components of one candidate group, by Jaccard similarity alone.

    Of two sets that are ``least`` similar, the rarest shingles of the group in each, all but
    ``least`` of its size and one, share a shingle; only texts that meet so are compared, and pairs
    that are one component already are not. In a pair of blocks only pairs across the two count,
    unless the pair is a block with itself.
    """
    label, out = np.arange(len(node)), []
    size = np.array([len(g) for g in grams])
    both = len(np.unique(block)) > 1
    owner = np.repeat(np.arange(len(node)), size)
    _, gram, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    rarity = np.empty(len(often), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often))
    gram = rarity[gram]
    gram = gram[np.lexsort((gram, owner))]  # owners are in order, so only their shingles move
    place = np.arange(len(gram)) - np.repeat(np.append(0, size.cumsum())[:-1], size)
    first = place < (size - np.ceil(least * size - 1e-9) + 1)[owner]
    owner, gram = owner[first], gram[first]
    ends = np.append(0, np.bincount(owner, minlength=len(node)).cumsum())
    order = np.argsort(gram, kind="stable")
    met, low = owner[order], np.searchsorted(gram[order], gram, "left")
    high = np.searchsorted(gram[order], gram, "right")
    empty = np.flatnonzero(size == 0)
    for i in range(len(node) - 1):
        runs = [met[low[k] : high[k]] for k in range(ends[i], ends[i + 1]) if high[k] - low[k] > 1]
        j = np.unique(np.concatenate(runs)) if runs else empty if not size[i] else np.zeros(0, np.int64)
        j = j[(j > i) & (label[j] != label[i])]
        if both:
            j = j[block[j] != block[i]]
        j = j[(np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]))]
        if not len(j):
            continue
        at = np.append(0, size[j].cumsum())[:-1]
        shared_ = np.isin(np.concatenate([grams[k] for k in j]), grams[i])
        same = np.where(size[j] > 0, np.add.reduceat(np.append(shared_, False), at), 0)
        for k in j[same >= least * (size[j] + size[i] - same)]:
            if label[k] != label[i]:
                out.append((int(node[i]), int(node[k])))
                label[label == label[k]] = label[i]
    return out


def _verify_sorted(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (root, pair, block, node, grams) sorted by (root, pair) to links (u, v)."""
    held: list[tuple] = []

    def give() -> list[tuple[int, int]]:
        node, block = (np.array([r[k] for r in held]) for k in (3, 2))
        return similar_links(node, block, [r[4] for r in held], least) if len(held) > 1 else []

    for batch in batches:
        out: list[tuple[int, int]] = []
        cols = [c.to_pylist() for c in batch.columns[:4]]
        lists = batch.column(4)
        for i, row in enumerate(zip(*cols, strict=True)):
            if held and held[-1][:2] != row[:2]:
                out += give()
                held = []
            held.append((*row, lists[i].values.to_numpy(zero_copy_only=False)))
        yield _edges(out)
    yield _edges(give() if held else [])


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def gram_sets(docs: DataFrame, width: int, wanted: shared.Sieve) -> DataFrame:
    """Of the rows of ``docs`` (doc_id, hash, text) that pass the sieve: the sorted set of 64-bit shingle hashes."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            some = batch.filter(pa.array(wanted.test(batch.columns[3:])))
            sets = [gram_hashes(t, width) for t in some.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "hash", "grams"])

        return work

    placed = docs.select("doc_id", "hash", "text", *[p.alias(f"p{k}") for k, p in enumerate(wanted.places(F.col("doc_id")))])
    return shared.arrow_map(placed, "doc_id long, hash string, grams array<long>", make, text=2)


def deduplicate(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, least: float = SIMILAR, members: int = MEMBERS) -> DataFrame:
    """The rows of ``docs``, as they are, without all but one of each group of copies.

    Equal texts are one group at once. Distinct texts are candidates where their SimHash fingerprints
    differ in ``radius`` or fewer bits or their sets of ``width``-word shingles share a MinHash band,
    directly or by way of others, and copies where those sets have a Jaccard similarity of ``least``. Of the documents that copies connect, the one with the
    least doc_id stays. Candidate groups of over ``members`` texts, or ``HASHES`` shingles, are compared block by block.

    Rows without a doc_id stay, as nothing names them. Of rows with equal doc_id and text one stays;
    texts under one doc_id are one document when groups are formed.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.where("doc_id IS NOT NULL").select("doc_id", body.alias("text"), F.md5(body.cast("binary")).alias("hash"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            sets = (gram_hashes(t, width) for t in texts)
            minima, size = zip(*((bands(g), len(g)) for g in sets), strict=True) if texts else ((), ())
            told = [batch.column(0), batch.column(2), pa.array(fps, pa.int64()), pa.array(minima, pa.list_(pa.int64())), pa.array(size, pa.int64())]
            return pa.RecordBatch.from_arrays(told, names=["doc_id", "hash", "fp", "bands", "size"])

        return work

    prints = shared.stored(shared.arrow_map(marked, "doc_id long, hash string, fp long, bands array<long>, size long", make), "prints")
    texts = shared.stored(prints.groupBy("hash", "fp").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("size").alias("size")), "texts")
    close = links(texts.select("fp").distinct(), radius).unionByName(band_links(texts))
    near = components(close).toDF("fp", "root")
    rooted = shared.stored(texts.join(near, "fp", "left").select("node", "hash", "size", F.coalesce("root", "fp").alias("root")), "rooted")
    sizes = shared.stored(rooted.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("hashes")).where("n > 1"), "sizes")
    # While groups are few, their one row each goes to all tasks, and a group of most texts is dealt to no single one.
    some = shared.stored(rooted.join(shared.small(sizes, sizes.count()), "root"), "candidates")
    blocks = F.ceil(F.greatest(F.col("n") / (members // 2), 2 * F.col("hashes") / HASHES)).cast("int")
    large = (F.col("n") > members) | (F.col("hashes") > HASHES)
    sets = gram_sets(marked, width, shared.sieve(some, "node")).withColumnRenamed("doc_id", "node")
    placed = some.select("node", "hash", "root", F.when(large, blocks).otherwise(1).alias("blocks"))
    whole = sets.join(placed, ["node", "hash"]).dropDuplicates(["node", "hash"])
    b = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = whole.withColumn("block", b)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("block")) * F.col("blocks") + F.greatest(o, F.col("block")))
    dealt = cut.withColumn("pair", F.explode(pairs)).select("root", "pair", "block", "node", "grams")
    ordered = dealt.repartition("root", "pair").sortWithinPartitions("root", "pair", "node")
    found = ordered.mapInArrow(lambda batches: _verify_sorted(batches, least), "u long, v long")
    gone = components(found).select(F.col("node").alias("gone"))
    stay = texts.join(gone, F.col("node") == F.col("gone"), "left_anti")
    times = prints.join(stay.select("hash", "node"), "hash").where("doc_id = node").groupBy("node", "hash").agg(F.count("*").alias("times"))
    kept = shared.stored(times.select(F.col("node").alias("k_id"), F.col("hash").alias("k_hash"), "times"), "kept")
    # Only texts that may have to go, or that repeat, are dealt out and joined; the others stay where they are.
    sure = kept.where("times = 1").select(F.col("k_id").alias("doc_id"), F.col("k_hash").alias("hash"))
    doubtful = prints.join(sure, ["doc_id", "hash"], "left_anti").select("doc_id")
    unsure = shared.sieve(shared.stored(doubtful, "doubtful"), "doc_id")
    named = docs.where("doc_id IS NOT NULL").withColumn("k_doubt", unsure(F.col("doc_id")))
    rest = named.where("k_doubt").withColumn("k_text", F.md5(body.cast("binary")))
    met = rest.join(kept, (F.col("doc_id") == F.col("k_id")) & (F.col("k_text") == F.col("k_hash")))
    once = met.where("times = 1").select(*docs.columns)
    again = met.where("times > 1").dropDuplicates(["k_id", "k_hash"]).select(*docs.columns)
    nameless = docs.where("doc_id IS NULL")
    return named.where("NOT k_doubt").select(*docs.columns).unionByName(once).unionByName(again).unionByName(nameless)
