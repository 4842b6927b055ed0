"""Repeated passages of many words by prefix-partitioned suffix trees.

A *window* is ``depth`` consecutive words of one document. A window goes if its word sequence also
starts earlier (in a smaller doc_id, or earlier in the same document), and every word that such a
window covers is removed. Windows are judged on the input, not on what is left.

How it runs.

1. Texts that equal each other wholly are told by a digest; the first of each is its representative.
   All windows of another copy start earlier there, so a copy needs no tree.
2. Leaves that hang above depth ``depth`` are pruned before any tree is built. In each window the
   run of ``GRAM`` words with the least hash is its *anchor*. Equal windows have equal anchors at
   equal places, so a window whose anchor occurs once in the corpus can't repeat. Some seventh of
   all places are anchors; only their hashes are counted.
3. The suffixes that begin at the windows left, cut at ``depth`` words, are dealt to groups by
   prefixes of variable length: a prefix that more suffixes begin with than a group holds is made
   longer (``LENGTHS``), over all rows and exactly. What is still too frequent at full depth is one
   node of the tree, whose leaves are dealt out by document and met again by their firsts alone.
4. Spark sorts each group's suffixes (on disk where need be), which puts the leaves of its tree in
   order. The common prefix of neighbours is the depth of the internal node above both; a node of
   ``depth`` words or more is a repeat, its leaves stand together, earliest first, and all but the
   earliest go. One pass needs the last suffix only, so memory does not grow with a group.

Overlapping windows of one document merge to maximal spans.

A suffix is shipped as a byte of each word's hash and a 64-bit hash of its first ``depth`` words. Nodes of
full depth need all of them equal, shallower ones only say where groups part. Texts are told by MD5.

Odd rows: a null or empty text, or one of fewer than ``depth`` words, has no window and loses
nothing. A null doc_id counts as larger than any other. Rows that agree in doc_id and text are one
document and get equal results; different texts of one doc_id are ordered by their digests. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

#: Words of a window, and of the run by which a window is known.
DEPTH, GRAM = 20, 8
#: Prefix lengths, in words, that are tried in turn; the full depth follows.
LENGTHS = (2, 4, 8)
#: Suffixes of a group at most, where a longer prefix or dealing by document can divide it; a group of ``LOW`` is never divided.
GROUP, LOW = 100_000, 1_000


def _anchors(w: words.Words, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows (word numbers), each window's anchor (word number), and hashes of runs by place."""
    gram = min(GRAM, depth)
    hashes = w.hashes()
    value = words.runs(hashes, gram)
    at = words.least(value, depth - gram + 1)
    text = w.text_of()
    whole = np.flatnonzero(text[: len(at)] == text[len(text) - len(at) :]) if len(at) else np.zeros(0, np.int64)
    return whole, at[whole], value


def _places(value: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """What ``Sieve.places`` gives for a long column, in numpy: Spark's xxhash64 of the number and of 1, 2, 3."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def end(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    one = end(turn((np.uint64(42) + p5 + np.uint64(8)) ^ (turn(value * p2, 31) * p1), 27) * p1 + p4)
    for k in (1, 2, 3):
        two = (one + p5 + np.uint64(4)) ^ np.array([k], np.uint64) * p1
        yield (end(turn(two, 23) * p2 + p3) & np.uint64(bits - 1)).astype(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, the text's digest, and one of both; nothing else is looked at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    told = shared.document_columns(docs).select("doc_id", text.alias("text"), F.md5(text).alias("dig"))
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(" "), F.col("dig"))
    return told.select("doc_id", "text", F.unhex("dig").alias("dig"), F.unhex(F.md5(both)).alias("key"))


def _counted(keyed: DataFrame, depth: int) -> DataFrame:
    """Anchors that occur at two places of the corpus or more, copies of one text aside."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = words.split(batch.column(1))
            _, at, value = _anchors(w, depth)
            at = at[np.diff(at, prepend=-1) != 0]  # anchors never go back
            text = np.searchsorted(w.first, at, side="right") - 1
            told = np.array([int.from_bytes(x[:8], "big") for x in batch.column(2).to_pylist()], np.uint64)
            where = words.mix(told[text] + words.mix(at - w.first[text]))
            return pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), pa.array(where.view(np.int64))], names=["h", "place"])

        return work

    places = shared.arrow_map(keyed.select("doc_id", "text", "dig"), "h long, place long", make)
    both = places.groupBy("h").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    return both.where(F.col("low") != F.col("high")).select("h")


def _looked_up(keyed: DataFrame, sieve: shared.Sieve, depth: int) -> DataFrame:
    """Per row: number of words, digest of all of them, and its anchors that may repeat, with their places."""
    schema = "doc_id long, dig binary, key binary, n_words long, whole string, h array<long>, place array<int>"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = words.split(batch.column(1))
            _, at, value = _anchors(w, depth)
            at = at[np.diff(at, prepend=-1) != 0]
            if len(at):
                at = at[sieve.test([pa.array(p) for p in _places(value[at], sieve.bits)])]
            ends = pa.array(np.searchsorted(at, w.first), pa.int32())
            text = np.searchsorted(w.first, at, side="right") - 1
            told = [hashlib.sha256(x).hexdigest() for x in w.joined()]
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(value[at].view(np.int64)), pa.array(at - w.first[text], pa.int32()))]
            arrays = [batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(w.first), pa.int64()), pa.array(told), *lists]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "dig", "key", "n_words", "whole", "h", "place"])

        return work

    return shared.arrow_map(keyed.select("doc_id", "text", "dig", "key"), schema, make)


def _suffixes(texts: DataFrame, depth: int) -> DataFrame:
    """The suffixes at windows whose anchor is among ``place``: a byte for each of ``depth`` words, then the hash of them all."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = words.split(batch.column(1))
            start, at, _ = _anchors(w, depth)
            wanted = np.zeros(len(w.start) + 1, bool)
            places = batch.column(2)
            owner = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy(zero_copy_only=False))
            wanted[places.flatten().to_numpy() + w.first[owner]] = True
            start = start[wanted[at]]
            hashes = w.hashes()
            run = np.empty((len(start), depth + 8), np.uint8)
            run[:, :depth] = (hashes >> np.uint64(56)).astype(np.uint8)[start[:, None] + np.arange(depth)]
            run[:, depth:] = words.runs(hashes, depth)[start][:, None].view(np.uint8)
            ends = pa.py_buffer(np.arange(len(start) + 1, dtype=np.int32) * (depth + 8))
            held = pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(run.tobytes())])
            text = np.searchsorted(w.first, start, side="right") - 1
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(start - w.first[text], pa.int32()), held], names=["no", "start", "run"])

        return work

    return shared.arrow_map(texts.select("no", "text", "place"), "no long, start int, run binary", make)


def _grouped(suffixes: DataFrame, depth: int, group: int) -> DataFrame:
    """``suffixes`` with the length of the prefix that names their group, and ``salt`` where one node is dealt out.

    Of each length only what is too frequent is counted on. A group holds at least a share of all
    suffixes, so the frequent prefixes of a length, which are broadcast, are ``FEW`` at most.
    """
    partitions = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables, most, open_ = [], 0, suffixes
    for n in [*[n for n in LENGTHS if n < depth], depth + 8]:
        counts = open_.groupBy(F.substring("run", 1, n).alias("p")).count()
        if not tables:
            counts = shared.stored(counts, "prefixes")
            whole = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
            most = max(min(group, max(LOW, whole // (4 * partitions))), whole // shared.FEW)
        frequent = shared.stored(counts.where(F.col("count") > most).select("p", F.ceil(F.col("count") / most).cast("int").alias("parts")), "frequent")
        tables.append((n, frequent))
        if frequent.isEmpty():
            break
        open_ = open_.join(F.broadcast(frequent), F.substring("run", 1, n) == F.col("p"), "leftsemi")
    out = suffixes.withColumns({"size": F.lit(None).cast("int"), "salt": F.lit(0)})
    for n, frequent in tables:
        met = out.join(F.broadcast(frequent), F.col("size").isNull() & (F.substring("run", 1, n) == F.col("p")), "left")
        if n < depth:
            out = met.withColumn("size", F.coalesce("size", F.when(F.col("parts").isNull(), F.lit(n)))).drop("p", "parts")
        else:
            dealt = F.pmod(F.xxhash64("no"), F.col("parts")).cast("int") + 1
            out = met.withColumns({"size": F.coalesce("size", F.lit(n)), "salt": F.coalesce(dealt, F.lit(0))}).drop("p", "parts")
    return out


def _leaves(rows: DataFrame, depth: int) -> DataFrame:
    """Leaves of the subtrees of sorted groups: ``first`` marks the earliest leaf of its node.

    The other leaves lie below a node of ``depth`` words together with an earlier one. The first leaf
    of a node that was dealt out keeps its ``run``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, depth + 8), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            here = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, depth + 8)
            both = np.concatenate([last, here])
            differ = both[1:] != both[:-1]
            common = np.where(differ.any(axis=1), np.minimum(differ.argmax(axis=1), depth - 1), depth)  # words shared with the suffix before
            first = np.concatenate([np.ones(1 - len(last), bool), common < depth])
            last = here[-1:].copy()
            kept = pc.if_else(pa.array(first & (batch.column(3).to_numpy() > 0)), batch.column(2), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], kept, pa.array(first)], names=["no", "start", "run", "first"])

    prefix = F.expr("substring(run, 1, size)")
    dealt = rows.repartition(prefix, "salt").sortWithinPartitions("run", "no", "start")
    return dealt.select("no", "start", "run", "salt").mapInArrow(run, "no long, start int, run binary, first boolean")


def _representatives(keyed: DataFrame) -> DataFrame:
    """Of each text the row that stands first."""
    who = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    return keyed.groupBy("dig").agg(who.alias("who")).select(F.col("who.key").alias("key"))


def _cut(texts: DataFrame, depth: int) -> DataFrame:
    """``texts`` with the starts of windows that go: what is left, its digest, and the spans taken out."""
    schema = "key binary, n_removed long, kept string, kept_sha256 string, spans array<struct<start: int, n_words: int>>"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = words.split(batch.column(1))
            starts = batch.column(2)
            owner = np.repeat(np.arange(len(starts)), starts.value_lengths().to_numpy(zero_copy_only=False))
            begin = starts.flatten().to_numpy() + w.first[owner]
            edges = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + depth, -1)
            gone = np.cumsum(edges)[:-1] > 0
            held = w.joined(~gone)
            n = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            spans = []
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                step = np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))
                spans.append([{"start": int(s), "n_words": int(e - s)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32())]))
            told = [hashlib.sha256(x).hexdigest() for x in held]
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array([x.decode() for x in held]), pa.array(told), pa.array(spans, kind)]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "n_removed", "kept", "kept_sha256", "spans"])

        return work

    return shared.arrow_map(texts.select("key", "text", "starts"), schema, make)


def _windows(keyed: DataFrame, depth: int, group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row its words, the representatives, and the starts of windows that go per representative."""
    repeated = shared.stored(_counted(keyed, depth), "anchors")
    told = shared.stored(_looked_up(keyed, shared.sieve(repeated, "h"), depth), "looked-up")
    first = shared.stored(_representatives(told), "firsts")
    own = told.where(F.size("h") > 0).dropDuplicates(["key"]).join(first, "key", "leftsemi")
    one = own.select("key", F.explode(F.arrays_zip("h", "place")).alias("x"))
    real = one.select("key", F.col("x.h").alias("h"), F.col("x.place").alias("place")).join(repeated, "h", "leftsemi")
    # Numbers that follow the order of doc_id (null last) and digest, so that they stand for both from here on.
    named = real.groupBy("key").agg(F.collect_list("place").alias("place")).join(told.select("key", "doc_id", "dig").dropDuplicates(["key"]), "key")
    inorder = named.orderBy(F.col("doc_id").asc_nulls_last(), "dig").select("key", "place")
    wanted = shared.stored(inorder.withColumn("no", F.monotonically_increasing_id()), "wanted", even=False)
    texts = shared.stored(_with_texts(keyed, wanted).select("no", "text", "place"), "texts", even=False)
    leaves = shared.stored(_leaves(_grouped(_suffixes(texts, depth), depth, group), depth), "leaves", even=False)
    # A node whose leaves were dealt out: the firsts of its parts meet, and all but the earliest go.
    firsts = leaves.where("first and run is not null").select("no", "start", "run", F.lit(depth + 8).alias("size"), F.lit(0).alias("salt"))
    gone = leaves.where("not first").select("no", "start").unionByName(_leaves(firsts, depth).where("not first").select("no", "start"))
    starts = gone.groupBy("no").agg(F.collect_list("start").alias("starts"))
    cut = shared.stored(wanted.select("no", "key").join(starts, "no").drop("no"), "gone")
    for done in (texts, leaves, wanted):
        shared.dropped(keyed.sparkSession, done)
    return told, first, cut


def _with_texts(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with their texts; only texts that a bounded sieve lets through are shuffled."""
    texts = keyed.where(shared.sieve(rows, "key")(F.col("key"))).select("key", "text").dropDuplicates(["key"])
    return rows.join(texts, "key")


def cut_repeats(docs: DataFrame, depth: int = DEPTH, group: int = GROUP) -> DataFrame:
    """Per document: n_words, n_removed, the text left (words joined by one space), its digest, and the spans taken out.

    ``kept`` is null where nothing was taken out, as the text itself stands then.
    """
    if depth < 2:
        raise ValueError("a window has two words or more")
    keyed = _keyed(docs)
    told, first, gone = _windows(keyed, depth, group)
    cut = _cut(_with_texts(keyed, gone), depth)
    own = first.join(cut, "key", "left").withColumn("own", F.lit(True))
    rows = told.select("key", "doc_id", "n_words", "whole").join(own, "key", "left")
    copy = F.col("own").isNull() & (F.col("n_words") >= depth)
    none = F.array().cast("array<struct<start: int, n_words: int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("n_words")))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM w WHERE len(w) >= 20),
x AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) AS h FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS gone FROM x),
g AS (SELECT DISTINCT doc_id, i + o AS j FROM r, (SELECT unnest(range(20)) AS o) WHERE gone),
l AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.j) AS kept FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(l.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""
