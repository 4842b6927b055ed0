"""A TF-IDF search index of immutable segments: rows are added without rebuilding what is there.

A segment holds, for its rows: ``postings`` (term, block, rows, tfs) by parts of the terms and in order, with the largest
``tf`` of the term in the block and its ``df`` when it was written, ``rows`` with the words of a row, and ``lengths`` with ``base``,
a row's length by the weights of then. Blocks are of rows of about equal length. Terms that only older rows have stand in ``postings``
without rows, so it also has the totals of all terms. A state (see ``manifest``) names the segments and where the totals are.

A block of texts sends its terms packed by bucket, once; a task merges one bucket, adds the older totals, and writes the postings.

Weights depend on the whole corpus, so lengths of older segments age. ``add`` therefore measures, over the
vocabulary only, by how much the weights of an older segment have fallen at most (``ratio``). A row is
now at least ``ratio * base`` long, which bounds its score from above. A search scores the blocks of the
highest bounds, takes the exact score of the best rows for a threshold, and reads further blocks and exact
lengths only where a bound reaches it: the result is exact, whatever the segments.

``compact`` makes one segment of all, from the stored words of rows, with fresh weights.

Terms are words of two characters or more and pairs of neighbours, as in ``search``. Rows without terms are
counted but stored nowhere. Row keys must be new; null texts have no terms. Stable terms, which lengths are
bounded by, are in at least ``min_df`` rows and at most half of all; they stay in the vocabulary unless one
rises over ``max_df``, which makes its segments' ratio zero: then nothing is skipped there.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.manifest import Manifest, State
from tesserae.operators.search import PARTS, _dealt, _firsts, counted_words, packed_terms, postings, term_hashes, terms, unpacked, words_of
from tesserae.session import kept, slim_batches

#: Blocks of rows in a segment, blocks of one class of length, and blocks that a search looks at first.
BLOCKS, CUTS, FIRST = 256, 8, 8
#: Share of rows above which a term bounds no length, and the impact of a row that nothing bounds.
COMMON, ENDLESS = 0.5, 1e300
#: Words of texts for each task that merges buckets of terms, terms of older totals packed at once, and rows or terms that are sent to every task at most.
BUCKET, PACKED, FEW = 1_000_000, 500_000, 200_000


def _block(keys: pa.Array, n: np.ndarray) -> np.ndarray:
    """Blocks of rows by how many words they have, half a power of two a class, and by hash."""
    length = np.minimum(2 * np.log2(n + 1.0), BLOCKS // CUTS - 1).astype(np.int64)
    return length * CUTS + (pd.util.hash_array(keys.to_numpy(zero_copy_only=False)) % CUTS).astype(np.int64)


def _weight(df: Column, n: int) -> Column:
    return F.log(F.lit(1.0 + n) / (1 + df)) + 1


def _bounds(state: State, n: int) -> tuple[Column, Column]:
    df = F.col("df")
    return (df >= state["min_df"]) & (df <= state["max_df"] * n), (df >= state["min_df"]) & (df <= min(COMMON, state["max_df"]) * n)


def _postings(spark: SparkSession, segment: str) -> DataFrame:
    """The lists of a segment, and the totals that were written with them."""
    kind = spark.read.parquet(f"{segment}/rows").schema["row"].dataType.simpleString()
    return spark.read.schema(_listed(kind)).parquet(f"{segment}/postings")


def _totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, df long, head boolean, part int").parquet(path).where("head").select("part", "term", "df")


def _listed(kind: str) -> str:
    return f"part int, term string, block smallint, top int, df long, head boolean, rows array<{kind}>, tfs array<int>"


def _packed_totals(totals: DataFrame, buckets: int) -> DataFrame:
    """(bucket, data) of a table (term, df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= PACKED:
                yield from deal(held)
                held, n = [], 0
        if n:
            yield from deal(held)

    def deal(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, df = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
        yield from _dealt(term_hashes(names) % buckets, names, np.ones(len(names), np.int64), {"olds": df})

    return totals.select("term", "df").mapInArrow(run, "bucket int, data binary")


def _merged(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each bucket's lists, a record for each term and block, and one for each term that older totals alone have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, sent in unpacked(batches):
            yield from merge(bucket % PARTS, sent)

    def merge(part: int, sent: list[dict[str, pa.Array]], most: int = 50_000) -> Iterator[pa.RecordBatch]:
        new, old = ([x for x in sent if ("olds" in x) == told] for told in (False, True))
        flat = lambda of, column, kind: pa.concat_arrays([pa.array([], kind), *[x[column] for x in of]])
        sizes = flat(new, "sizes", pa.int32()).to_numpy()
        names = pa.concat_arrays([flat(new, "terms", pa.string()), flat(old, "terms", pa.string())]).dictionary_encode()
        order = np.argsort(names.dictionary.to_numpy(zero_copy_only=False))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[names.indices.to_numpy(zero_copy_only=False)]
        own, before = code[: len(sizes)], code[len(sizes) :]
        df = np.bincount(own, sizes, len(order)) + np.bincount(before, flat(old, "olds", pa.int64()).to_numpy(), len(order))
        cell = np.repeat(own, sizes) * BLOCKS + flat(new, "blocks", pa.int16()).to_numpy()
        by = np.argsort(cell, kind="stable")
        cell, rows, tfs = cell[by], flat(new, "rows", kind).take(pa.array(by)), flat(new, "tfs", pa.int32()).take(pa.array(by))
        start = _firsts(cell) if len(cell) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(tfs.to_numpy(), start) if len(cell) else np.zeros(0, np.int32)
        term, block = np.divmod(cell[start], BLOCKS)
        alone = np.setdiff1d(before, term)
        term, long = np.append(term, alone), np.append(np.diff(np.append(start, len(cell))), np.zeros(len(alone), np.int64))
        block, top = np.append(block, np.full(len(alone), -1)), np.append(top, np.zeros(len(alone), np.int32))
        by = np.argsort(term, kind="stable")
        term, block, top, ends = term[by], block[by], top[by], np.append(0, np.cumsum(long[by]))
        head = np.zeros(len(term), bool)
        head[_firsts(term)] = True
        said = names.dictionary.take(pa.array(order))
        for low in range(0, len(term), most):
            at = slice(low, low + most)
            here = ends[low : low + len(term[at]) + 1]
            offsets, of = pa.array((here - here[0]).astype(np.int32)), slice(here[0], here[-1])
            columns = [pa.array(np.full(len(term[at]), part, np.int32)), said.take(pa.array(term[at])), pa.array(block[at].astype(np.int16), mask=block[at] < 0), pa.array(top[at].astype(np.int32))]
            columns += [pa.array(df[term[at]].astype(np.int64)), pa.array(head[at]), *[pa.ListArray.from_arrays(offsets, x[of]) for x in (rows, tfs)]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "term", "block", "top", "df", "head", "rows", "tfs"])

    return run


def _segment(spark: SparkSession, path: str, words: int, old: str | None, n: int, state: State) -> None:
    """Write the postings and lengths of the stored rows, ``words`` in all, with the weights of their terms and the ``old`` totals over ``n`` rows."""
    worded = spark.read.parquet(f"{path}/rows")
    kind, buckets = worded.schema["row"].dataType.simpleString(), PARTS * max(1, -(-words // (PARTS * BUCKET)))
    lists = packed_terms(worded, "row", "words", buckets, _block)
    if old is not None:
        lists = lists.union(_packed_totals(_totals(spark, old), buckets))
    slim_batches(spark)
    made = lists.repartitionById(-(-words // BUCKET) or 1, "bucket").mapInArrow(_merged(to_arrow_type(worded.schema["row"].dataType)), _listed(kind))
    made.write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/postings")
    idf = F.when(_bounds(state, n)[1], _weight(F.col("df"), n)).otherwise(F.lit(0.0))
    held = _postings(spark, path).where("block IS NOT NULL").select("block", idf.alias("idf"), "rows", "tfs").coalesce(PARTS)  # a row has many terms in each task, which go together there
    own = (1 + F.log("tf")) * F.col("idf")
    postings(held, "row", "block", "idf").groupBy("row").agg(F.first("block").alias("block"), F.sqrt(F.sum(own * own)).alias("base")).write.parquet(f"{path}/lengths")


def _ratios(spark: SparkSession, segments: list[dict], totals: str, n: int, state: State) -> list[dict]:
    """The segments with what share of its length a row kept at least; one that was made with these totals kept all."""
    older = [s for s in segments if f"{s['path']}/postings" != totals]
    if not older:
        return [s | {"ratio": 1.0} for s in segments]
    now = _totals(spark, totals).where(_bounds(state, n)[0]).select("term", _weight(F.col("df"), n).alias("now"))
    known = [_postings(spark, s["path"]).where(F.col("head") & F.col("block").isNotNull() & _bounds(state, s["weighed"])[1]).select("term", _weight(F.col("df"), s["weighed"]).alias("idf"), F.lit(s["path"]).alias("path")) for s in older]
    old = reduce(DataFrame.union, known)
    fell = {r.path: r.low for r in old.join(now, "term", "left").groupBy("path").agg(F.min(F.coalesce(F.col("now") / F.col("idf"), F.lit(0.0))).alias("low")).collect()}
    return [s | {"ratio": min(1.0, fell.get(s["path"], 1.0))} for s in segments]


def add(df: DataFrame, path: str, key: str = "_row_idx", text: str = "text", min_df: int = 2, max_df: float = 0.9) -> None:
    """Add rows to the index at ``path``; the first call makes it, with its bounds of rows per term."""
    spark, manifest, new = df.sparkSession, Manifest(df.sparkSession, path), f"{path}/segment-{uuid.uuid4().hex}"
    seen, written = Observation(), None
    worded = df.select(F.col(key).alias("row"), words_of(F.col(text)).alias("words"))
    worded.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).where(F.size("words") > 0).write.option("compression", "zstd").parquet(f"{new}/rows")
    count = seen.get["rows"]
    for _ in range(100):
        number, state = manifest.last()
        state = state or {"n": 0, "segments": [], "totals": None, "min_df": min_df, "max_df": max_df}
        n, totals = state["n"] + count, f"{new}/postings"
        if written is None:  # weights of any state do for a segment, its ratio tells what they are worth
            _segment(spark, new, seen.get["words"], state["totals"], n, state)
            written = {"path": new, "n": count, "weighed": n}
        else:  # another writer was faster: its totals and these rows' own
            own = _postings(spark, new).where("block IS NOT NULL").select("part", "term", F.size("rows").cast("long").alias("df"))
            whole = (own if state["totals"] is None else own.union(_totals(spark, state["totals"]))).groupBy("part", "term").agg(F.sum("df").alias("df"))
            totals = f"{path}/totals-{uuid.uuid4().hex}"
            whole.withColumn("head", F.lit(True)).repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(totals)
        segments = _ratios(spark, [*state["segments"], written], totals, n, state)
        if manifest.commit(number, state | {"n": n, "segments": segments, "totals": totals}):
            return
    raise RuntimeError("other writers were faster each time")


def compact(spark: SparkSession, path: str) -> None:
    """One segment in place of all; states before stay readable. Fails if rows were added meanwhile."""
    manifest = Manifest(spark, path)
    number, state = manifest.last()
    new, seen = f"{path}/segment-{uuid.uuid4().hex}", Observation()
    rows = reduce(DataFrame.union, [spark.read.parquet(f"{s['path']}/rows") for s in state["segments"]])
    rows.observe(seen, F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).write.option("compression", "zstd").parquet(f"{new}/rows")
    _segment(spark, new, seen.get["words"], None, state["n"], state)
    if not manifest.commit(number, state | {"totals": f"{new}/postings", "segments": [{"path": new, "n": state["n"], "weighed": state["n"], "ratio": 1.0}]}):
        raise RuntimeError("rows were added meanwhile; compact again")


class Searcher:
    """Searches on one state of an index. ``read`` has the tables and blocks that the last search opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.state = Manifest(spark, path).last()[1]
        self.read: dict[str, int] = {}

    def _terms(self, query: str) -> dict[str, tuple[float, float, int]]:
        """Of each known term its weight in the query, its weight in rows, and its part."""
        said = self.spark.range(1).select(F.explode(terms(F.lit(query))).alias("term")).collect()
        count = Counter(r.term for r in said)
        if not count:
            return {}
        part = dict(zip(count, (term_hashes(pa.array(list(count))) % PARTS).tolist(), strict=True))
        totals = _totals(self.spark, self.state["totals"]).where(F.col("part").isin(sorted(set(part.values()))) & F.col("term").isin(sorted(count)))
        n, out = self.state["n"], {}
        for r in totals.select("term", "df").collect():  # terms of the query
            if self.state["min_df"] <= r.df <= self.state["max_df"] * n:
                idf = log((1 + n) / (1 + r.df)) + 1
                out[r.term] = ((1 + log(count[r.term])) * idf, idf, part[r.term])
        return out

    def _each(self, make: Callable[[str], DataFrame]) -> DataFrame:
        """What ``make`` gives for each segment's path, with the segment's number and ratio."""
        return reduce(DataFrame.unionByName, [make(s["path"]).withColumns({"seg": F.lit(i), "ratio": F.lit(float(s["ratio"]))}) for i, s in enumerate(self.state["segments"])])

    def _table(self, wanted: dict, *columns: str) -> DataFrame:
        """Lists of the query's terms from all segments."""
        parts, words = sorted({p for _, _, p in wanted.values()}), sorted(wanted)
        found = F.col("part").isin(parts) & F.col("term").isin(words) & F.col("block").isNotNull()
        return self._each(lambda path: _postings(self.spark, path).where(found).select("term", "block", *columns))

    def search(self, query: str, k: int = 20) -> DataFrame:
        """(row, score) of the ``k`` best rows by cosine, scores above 0."""
        none = self.spark.range(0).select(F.col("id").alias("row"), F.lit(0.0).alias("score"))
        wanted = self._terms(query) if self.state.get("segments") else {}
        if not wanted:
            return none
        k, length = max(1, k), sqrt(sum(w * w for w, _, _ in wanted.values()))
        of = lambda i: F.create_map(*[x for t, v in wanted.items() for x in (F.lit(t), F.lit(float(v[i])))])[F.col("term")]
        unit = F.lit(1.0 / length)
        lengths = self._each(lambda path: self.spark.read.parquet(f"{path}/lengths"))
        lows = lengths.groupBy("seg", "block").agg(F.min("base").alias("low"))
        tops = self._table(wanted, "top").join(F.broadcast(lows), ["seg", "block"])  # BLOCKS rows a segment
        impact = F.when(F.col("low") > 0, (1 + F.log("top")) / F.col("low")).otherwise(F.lit(ENDLESS))
        bound = tops.groupBy("seg", "block").agg(F.try_divide(F.sum(of(0) * of(1) * impact) * unit, F.first("ratio")).alias("bound"))
        bound = kept(bound.withColumn("bound", F.coalesce("bound", F.lit(ENDLESS))), "bounds")  # BLOCKS rows a segment
        row = (F.sum(of(0) * of(1) * (1 + F.log("tf"))) * unit).alias("part")

        def scored(blocks: DataFrame) -> DataFrame:
            """(seg, row, part, most): a row's score times its length, and the most that its score can be."""
            here = self._table(wanted, "rows", "tfs").join(F.broadcast(blocks.select("seg", "block")), ["seg", "block"], "leftsemi")
            got = postings(here, "row", "seg", "term").groupBy("seg", "row").agg(row).join(lengths, ["seg", "row"])
            long = F.col("ratio") * F.col("base")
            return got.select("seg", "row", "part", F.when(long > 0, F.col("part") / long).otherwise(F.lit(ENDLESS)).alias("most"))

        first = scored(bound.orderBy(F.desc("bound"), "seg", "block").limit(FIRST)).orderBy(F.desc("most"), "row").limit(4 * k)
        best = [r.score for r in self._exact(first).orderBy(F.desc("score")).limit(k).collect()]
        least = (best[-1] if len(best) == k else 0.0) * (1 - 1e-9)
        reached = bound.where(F.col("bound") >= least)
        self.read = {"blocks": bound.count(), "scored": reached.count()}
        rows = kept(scored(reached).where(F.col("most") >= least), "reached")
        self.read["lengths"] = rows.count()
        return self._exact(rows).where("score > 0").orderBy(F.desc("score"), "row").limit(k)

    def _exact(self, rows: DataFrame) -> DataFrame:
        """(row, score) of ``rows`` by their lengths with the weights of now."""
        n, rows = self.state["n"], kept(rows.select("seg", "row", "part"), "asked")
        held = self._each(lambda path: self.spark.read.parquet(f"{path}/rows")).drop("ratio")
        met = held.join(F.broadcast(rows) if rows.count() <= FEW else rows, ["seg", "row"])
        each = kept(counted_words(met.select(F.struct("seg", "row", "part").alias("at"), "words"), "at", "words"), "held")
        now = _totals(self.spark, self.state["totals"]).where(_bounds(self.state, n)[0]).select("term", _weight(F.col("df"), n).alias("idf"))
        said = kept(each.select("term").distinct(), "said")
        if said.count() <= FEW:  # else all totals meet them by a shuffle
            now = F.broadcast(now.join(F.broadcast(said), "term", "leftsemi"))
        w = (1 + F.log("tf")) * F.col("idf")
        scored = each.join(now, "term").groupBy("at").agg((F.first("at.part") / F.sqrt(F.sum(w * w))).alias("score"))
        return scored.select(F.col("at.row").alias("row"), "score")
