"""TF-IDF search, quotes and exact vector search; an index is in ``segments``, a projection in ``layout``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.session import slim_batches

WORD = r"(?U)\w{2,}"


def words_of(c: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def terms(c: Column) -> Column:
    """The words of a text and their pairs."""
    return with_pairs(words_of(c))


def with_pairs(words: Column) -> Column:
    """Words and their pairs; where ``words`` is a column of its own, the text is searched once."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, F.when(b.isNotNull(), b)))
    whole = F.when(F.size(words) >= 2, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, whole)


def weights(df: DataFrame, key: str = "_row_idx", text: str = "text", min_df: int = 2, max_df: float = 0.9, features: int = 100_000) -> DataFrame:
    """(row, term, weight): 1 + ln tf, times smoothed idf, each row of unit length."""
    tf = counted_terms(df, key, text)
    n = df.agg(F.count("*").alias("n"))
    seen = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).crossJoin(F.broadcast(n))  # one row
    kept = seen.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).orderBy(F.desc("all"), "term").limit(features)
    idf = kept.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


#: Letters of texts for each task that merges counts of terms, and words of texts whose terms are looked up at once.
LETTERS, LOOKED_UP = 8_000_000, 500_000


def vocabulary(df: DataFrame, text: str = "text", min_df: int = 2, max_df: float = 0.9, features: int = 100_000) -> DataFrame:
    """(term, idf) of the ``features`` most frequent terms within the bounds; a block of texts sends its counts packed, once."""
    n, letters = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    buckets = -(-letters // LETTERS) or 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, LISTED):
            known, term, _, tf, start = _numbered(pa.concat_arrays([b.column(1) for b in held]))
            counts = {"df": pa.array(np.diff(np.append(start, len(tf)))), "all": pa.array(np.add.reduceat(tf.astype(np.int64), start))}
            yield from _dealt(_hashed(known, term[start]) % buckets, _named(known, term[start]), np.ones(len(start), np.int64), counts)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sent in unpacked(batches):
            names = pa.concat_arrays([x["terms"] for x in sent]).dictionary_encode()
            code, size = names.indices.to_numpy(zero_copy_only=False), len(names.dictionary)
            df, times = (np.bincount(code, np.concatenate([x[c].to_numpy() for x in sent]), size).astype(np.int64) for c in ("df", "all"))
            stays = np.flatnonzero((df >= min_df) & (df <= max_df * n))
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(stays)), pa.array(df[stays]), pa.array(times[stays])], names=["term", "df", "all"])

    slim_batches(df.sparkSession)
    counts = df.select(F.lit(0).alias("row"), words_of(F.col(text)).alias("words")).mapInArrow(count, "bucket int, data binary")
    seen = counts.repartitionById(buckets, "bucket").mapInArrow(total, "term string, df long, all long")
    return seen.orderBy(F.desc("all"), "term").limit(features).select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def numbered_rows(df: DataFrame, known: Broadcast, key: str = "_row_idx", text: str = "text") -> DataFrame:
    """(row, terms, tfs): the terms of each row by their places in ``known``, made where the text is; rows without such terms are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, LOOKED_UP):
            keys, words = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
            said, term, row, tf, start = _numbered(words)
            place = pc.fill_null(pc.index_in(_named(said, term[start]), known.value), -1).to_numpy(zero_copy_only=False)
            place = np.repeat(place, np.diff(np.append(start, len(term))))
            order = np.flatnonzero(place >= 0)
            order = order[np.argsort(row[order], kind="stable")]
            if not len(order):
                continue
            first = _firsts(row[order])
            offsets = pa.array(np.append(first, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in (place, tf)]
            made = pa.RecordBatch.from_arrays([keys.take(pa.array(row[order][first])), *lists], names=["row", "terms", "tfs"])
            for low in range(0, len(made), 2_000):
                yield made.slice(low, 2_000)

    slim_batches(df.sparkSession)
    return df.select(key, words_of(F.col(text)).alias("words")).mapInArrow(run, f"row {kind}, terms array<int>, tfs array<int>")


def counted_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, term, tf), one row per distinct term of a row, made within the row and not by a shuffle.

    Terms are put in order; the first of each run of equal ones stands for it, and the next one's place gives its length.
    """
    return counted_words(df.select(key, words_of(F.col(text)).alias("_w")), key, "_w")


def counted_words(worded: DataFrame, key: str, words: str) -> DataFrame:
    """``counted_terms`` of rows whose words are told."""
    made = worded.select(key, F.sort_array(with_pairs(F.col(words))).alias("_t"))
    at = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: ~F.get("_t", i).eqNullSafe(F.get("_t", i - 1)))
    firsts = made.where(F.size("_t") > 0).select(key, "_t", at.alias("_at"), F.size("_t").alias("_n"))
    runs = F.transform("_at", lambda i, j: F.struct(F.get("_t", i).alias("term"), (F.coalesce(F.get("_at", j + 1), F.col("_n")) - i).cast("long").alias("tf")))
    return firsts.select(key, F.explode(runs).alias("_r")).select(key, "_r.term", "_r.tf")


def search(df: DataFrame, query: str, k: int = 20, key: str = "_row_idx", text: str = "text", min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """(row, score) of the ``k`` best rows by cosine, scores above 0, without a stored index.

    Only rows with a term of the query can score, so only those need a length, and only the terms of
    those rows need weights. Texts are read twice; of the rest of the corpus nothing but counts is shuffled.
    """
    spark = df.sparkSession
    wanted = Counter(r for r in spark.range(1).select(F.explode(terms(F.lit(query))).alias("t")).toPandas()["t"])
    n = df.count()
    worded = df.select(key, text, words_of(F.col(text)).alias("_w"))
    own = worded.select(F.explode(F.array_intersect(with_pairs(F.col("_w")), F.array(*map(F.lit, wanted)))).alias("term")) if wanted else df.select(F.lit("").alias("term")).limit(0)
    seen = {r.term: r.n for r in own.groupBy("term").agg(F.count("*").alias("n")).collect()}
    rows = {t: log((1 + n) / (1 + c)) + 1 for t, c in seen.items() if min_df <= c <= max_df * n}
    mine = {t: (1 + log(c)) * rows[t] for t, c in wanted.items() if t in rows}
    length = sqrt(sum(w * w for w in mine.values())) or 1.0
    if not mine:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    idf = _idf(listed_terms(df, key, text).select("term", F.size("rows").alias("c")), n, min_df, max_df)
    hits = worded.where(F.arrays_overlap(with_pairs(F.col("_w")), F.array(*map(F.lit, mine))))
    tf = postings(listed_terms(hits, key, text), key, "term")
    q = F.create_map(*[x for t, w in mine.items() for x in (F.lit(t), F.lit(w / length))])
    w = (1 + F.log("tf")) * F.col("idf")
    scored = tf.join(idf, "term").groupBy(key).agg((F.sum(F.coalesce(F.try_element_at(q, F.col("term")), F.lit(0.0)) * w) / F.sqrt(F.sum(w * w))).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(max(1, k))


def _idf(each: DataFrame, n: int, min_df: int, max_df: float) -> DataFrame:
    """(term, idf) of the terms whose count of rows lies within the bounds; ``each`` has counts (term, c) of blocks of rows."""
    counts = each.groupBy("term").agg(F.sum("c").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return counts.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


#: Parts that a stored index is cut into by term, and words of a block of texts whose terms are listed together.
PARTS, LISTED = 64, 4_000_000


def listed_terms(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """(term, rows, tfs): of each term the rows of a block of texts that hold it, and how often each does.

    A task lists the terms of about ``most`` words at once, by sorted numbers of its own, so a term is written once a
    block and not once a row. Rows without terms are in no list.
    """
    kind = df.schema[key].dataType.simpleString()
    slim_batches(df.sparkSession)
    return df.select(F.col(key).alias("row"), words_of(F.col(text)).alias("words")).mapInArrow(_lists_of(most or LISTED), f"term string, rows array<{kind}>, tfs array<int>")


def _lists_of(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, most):
            yield from _lists(held)

    return run


def _firsts(sorted_numbers: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_numbers[1:] != sorted_numbers[:-1]]))


def _numbered(words: pa.Array, place: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words in order, and of the rows' terms in order: number of the term, place of the row, times, and where terms begin.

    A word's number is its place among the different words; a pair's follows from those of its words. A row's place is its own unless told.
    """
    said = words.flatten().dictionary_encode()
    order = pc.array_sort_indices(said.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number, v, d = rank[said.indices.to_numpy(zero_copy_only=False)], len(order), len(words)
    row = np.repeat(np.arange(d), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    at = row if place is None else place[row]
    pairs = ((v + number[:-1] * v + number[1:]) * d + at[:-1])[row[1:] == row[:-1]]
    cells = np.sort(np.concatenate([number * d + at, pairs]))
    first = _firsts(cells)
    tf = np.diff(np.append(first, len(cells))).astype(np.int32)
    term, at = np.divmod(cells[first], d)
    return said.dictionary.take(pa.array(order)), term, at, tf, _firsts(term)


def _named(said: pa.Array, term: np.ndarray) -> pa.Array:
    """The terms with these numbers; those of words come first."""
    v = len(said)
    left, right = np.divmod(term[term >= v] - v, v)
    take = lambda numbers: said.take(pa.array(numbers))
    return pa.concat_arrays([take(term[term < v]), pc.binary_join_element_wise(take(left), take(right), " ")])


def _lists(held: list[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    keys, words = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
    said, term, row, tf, start = _numbered(words)
    term, ends = term[start], np.append(start, len(term))
    for low in range(0, len(term), most):
        part = term[low : low + most]
        here = ends[low : low + len(part) + 1]
        offsets, of = pa.array((here - here[0]).astype(np.int32)), slice(here[0], here[-1])
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys.take(pa.array(row[of])), pa.array(tf[of]))]
        yield pa.RecordBatch.from_arrays([_named(said, part), *lists], names=["term", "rows", "tfs"])


def _mixed(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(34)).astype(np.int64)


#: A pair's hash is its first word's times this, and its second word's added.
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def term_hashes(names: pa.Array) -> np.ndarray:
    """Hashes of terms, the same in every process; a pair's follows from those of its words."""
    words = pc.split_pattern(names, " ")
    said = words.flatten().dictionary_encode()
    own = pd.util.hash_array(said.dictionary.to_numpy(zero_copy_only=False))[said.indices.to_numpy(zero_copy_only=False)]
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    out = own[first]
    out[n > 1] = out[n > 1] * _PAIR + own[first[n > 1] + 1]
    return _mixed(out)


def _hashed(said: pa.Array, term: np.ndarray) -> np.ndarray:
    """``term_hashes`` of the terms with these numbers; those of words come first."""
    v, own = len(said), pd.util.hash_array(said.to_numpy(zero_copy_only=False))
    left, right = np.divmod(term[term >= v] - v, v)
    return _mixed(np.concatenate([own[term[term < v]], own[left] * _PAIR + own[right]]))


def _dealt(bucket: np.ndarray, names: pa.Array, sizes: np.ndarray, columns: dict[str, pa.Array], most: int = 16) -> Iterator[pa.RecordBatch]:
    """(bucket, data): for each bucket its terms, and of each column the numbers of all its terms, ``sizes`` of them for each one, as compressed Arrow."""
    order = np.argsort(bucket, kind="stable")
    bucket, long = bucket[order], sizes[order]
    ends = np.append(0, np.cumsum(long))
    cells = np.repeat((np.cumsum(sizes) - sizes)[order] - ends[:-1], long) + np.arange(ends[-1])
    each = np.append(_firsts(bucket), len(bucket))
    for low in range(0, len(each) - 1, most):
        data = []
        for i, j in zip(each[low : low + most], each[low + 1 : low + most + 1], strict=False):
            inner = pa.array(cells[ends[i] : ends[j]])
            arrays = {"terms": names.take(pa.array(order[i:j])), "sizes": pa.array(long[i:j].astype(np.int32))} | {c: x.take(inner) for c, x in columns.items()}
            one = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays.values()], names=list(arrays))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_batch(one)
            data.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[each[low : low + len(data)]].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict[str, pa.Array]]]]:
    """Each bucket of a task, by parts, with what blocks of texts have sent to it."""
    held: dict[int, list[pa.Scalar]] = {}
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            held.setdefault(bucket, []).append(data)
    for bucket in sorted(held, key=lambda b: (b % PARTS, b)):
        sent = [pa.ipc.open_stream(x.as_buffer()).read_next_batch() for x in held.pop(bucket)]
        yield bucket, [{c: one.column(c).flatten() for c in one.schema.names} for one in sent]


def packed_terms(worded: DataFrame, key: str, words: str, buckets: int, block: Callable[[pa.Array, np.ndarray], np.ndarray]) -> DataFrame:
    """(bucket, data): of the terms of a block of texts all that go to one bucket, packed with their blocks, rows and times.

    ``block`` gives the blocks of rows by their keys and counts of words. A term's rows are in the order of their blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, LISTED):
            keys, said = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
            of = block(keys, pc.list_value_length(said).to_numpy(zero_copy_only=False))
            order = np.argsort(of, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            known, term, row, tf, start = _numbered(said, place)
            cells = {"blocks": pa.array(of[order][row].astype(np.int16)), "rows": keys.take(pa.array(order[row])), "tfs": pa.array(tf)}
            yield from _dealt(_hashed(known, term[start]) % buckets, _named(known, term[start]), np.diff(np.append(start, len(row))), cells)

    slim_batches(worded.sparkSession)
    return worded.select(key, words).mapInArrow(run, "bucket int, data binary")


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about ``most`` words together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(1).flatten())
        if n >= most:
            yield held
            held, n = [], 0
    if n:
        yield held


def by_part(lists: DataFrame) -> DataFrame:
    """``lists`` with ``part``, dealt out and sorted by part and term; large parts lie in several tasks."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64("term")
    placed = lists.withColumns({"part": F.pmod(hashed, F.lit(PARTS)).cast("int"), "_cut": F.pmod(F.shiftright(hashed, 8), F.lit(-(-4 * n // PARTS))).cast("int")})
    return placed.repartition("part", "_cut").sortWithinPartitions("part", "_cut", "term")


def build_index(df: DataFrame, path: str, key: str = "_row_idx", text: str = "text", min_df: int = 2, max_df: float = 0.9) -> None:
    """Write a search index: ``postings`` (term, idf, rows, tfs) by parts of the terms, in order, and ``lengths`` of rows.

    A search then reads the parts of its few terms only, and within them, by the order, few row groups. Lists of a
    block of rows are shuffled once, to their term; lengths are summed from what was written.
    """
    n = df.count()
    same = Window.partitionBy("part", "_cut", "term")
    counted = by_part(listed_terms(df, key, text)).withColumn("df", F.sum(F.size("rows")).over(same))
    known = counted.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    made = known.select("part", "term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"), "rows", "tfs")
    made.write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/postings")
    held = df.sparkSession.read.parquet(f"{path}/postings").select("idf", "rows", "tfs").coalesce(PARTS)  # a row has many terms in each task, which go together there
    squares = postings(held, key, "idf").groupBy(key).agg(F.sum((1 + F.log("tf")) * F.col("idf") * (1 + F.log("tf")) * F.col("idf")).alias("s"))
    squares.select(key, F.sqrt("s").alias("length")).write.parquet(f"{path}/lengths")


def postings(lists: DataFrame, key: str, *also: str) -> DataFrame:
    """A row for each row and term of ``lists``."""
    each = lists.select(*also, F.explode(F.arrays_zip("rows", "tfs")).alias("_x"))
    return each.select(*also, F.col("_x.rows").alias(key), F.col("_x.tfs").alias("tf"))


def search_index(spark: SparkSession, path: str, query: str, k: int = 20, key: str = "_row_idx") -> DataFrame:
    """(row, score) of the ``k`` best rows by cosine from a stored index, scores above 0."""
    wanted = spark.range(1).select(F.explode(terms(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("c"))
    told = {r.term: (r.c, r.part) for r in wanted.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).collect()}
    index = spark.read.parquet(f"{path}/postings")
    near = index.where(F.col("part").isin(sorted({p for _, p in told.values()})) & F.col("term").isin(sorted(told))) if told else index.limit(0)
    count = F.create_map(*[x for t, (c, _) in told.items() for x in (F.lit(t), F.lit(float(c)))]) if told else F.create_map(F.lit(""), F.lit(1.0))
    mine = near.withColumn("q", (1 + F.log(F.try_element_at(count, F.col("term")))) * F.col("idf"))
    length = F.broadcast(mine.select("term", "q").distinct().agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("asked")))  # one row
    met = postings(mine, key, "q", "idf").groupBy(key).agg(F.sum(F.col("q") * (1 + F.log("tf")) * F.col("idf")).alias("s"))
    scored = met.join(spark.read.parquet(f"{path}/lengths"), key).crossJoin(length)
    return scored.select(key, (F.col("s") / F.col("asked") / F.col("length")).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(max(1, k))


def quotes_by_confidence(tags: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` surest rows of each category."""
    rank = F.row_number().over(Window.partitionBy("cat_id").orderBy(F.desc_nulls_last("confidence"), "_row_idx"))
    return tags.withColumn("rank", rank).where(F.col("rank") <= k)


def random_quotes(tags: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    from .sampling import lot

    rank = F.row_number().over(Window.partitionBy("cat_id").orderBy(lot(seed), "_row_idx"))
    return tags.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_quotes(df: DataFrame, keywords: list[str], k: int = 5, **options) -> DataFrame:
    return search(df, " ".join(keywords), k, **options)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_free(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``size`` numbers as rows, and their lengths; NaN is the length of what has none: null, a null within, another size, zeros."""
    there = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == size
    m, length = np.zeros((len(column), size)), np.full(len(column), np.nan)
    if there.any() and size:
        flat = column.filter(pa.array(there)).flatten()
        m[there] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
        whole = there.copy()
        whole[there] = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)
        own = np.sqrt(_dots(m, m))
        length[whole & (own != 0)] = own[whole & (own != 0)]
    return m, length


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products row by row, summed from the first number on, as ``cosine`` does: equal rows give equal sums."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", most: int = 8_000) -> DataFrame:
    """(query, row, similarity): exact neighbours of a stated query set, in blocks of about ``most``.

    Queries are sent block by block; a task multiplies matrices to see which rows of a batch can be among the best
    ``k`` of a query, sums those as ``cosine`` does, and puts out its best ``k``. Ties go to the smaller key; rows without a similarity come last.
    """
    spark, blocks, out = vectors.sparkSession, max(1, -(-queries.count() // most)), None
    kind = vectors.schema[key].dataType.simpleString()
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, column).toArrow().combine_chunks()
        part = vectors.select(key, column).mapInArrow(_best_of(spark.sparkContext.broadcast(mine), k), f"query {kind}, row {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "row"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of(sent: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, said = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in sent.value.columns)
        sizes = pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False)
        names = asked.to_numpy(zero_copy_only=False)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                m, length = unit_free(batch.column(1), size)
                here = np.flatnonzero(sizes == size)
                for cut in range(0, len(here), 256):
                    at = here[cut : cut + 256]
                    q, own = unit_free(said.take(pa.array(at)), size)
                    over = own[:, None] * length
                    near = np.divide(q @ m.T, over)
                    near = np.where(np.isnan(over), -3.0, np.where(np.isnan(near), np.inf, near))  # below all cosines; NaN is above all
                    near[names[at][:, None] == keys] = -np.inf
                    if len(keys) > k:
                        last = np.partition(near, len(keys) - k, axis=1)[:, len(keys) - k, None]
                        i, j = np.nonzero((near >= last - 1e-9) & (near > -np.inf))
                    else:
                        i, j = np.nonzero(near > -np.inf)
                    for low in range(0, max(1, len(i)), 100_000):  # what can be among the best, summed in order
                        few = slice(low, low + 100_000)
                        near[i[few], j[few]] = np.where(near[i[few], j[few]] == -3.0, -3.0, _dots(m[j[few]], q[i[few]]) / (length[j[few]] * own[i[few]]))
                    exact = near[i, j]
                    order = np.lexsort((keys[j], -np.where(np.isnan(exact), np.inf, exact), i))
                    i, j, exact = i[order], j[order], exact[order]
                    first = np.searchsorted(i, np.arange(len(at)))
                    held = np.arange(len(i)) - first[i] < k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[at][i[held]], asked.type), pa.array(keys[j[held]], asked.type), pa.array(exact[held], mask=exact[held] == -3.0)], names=["query", "row", "similarity"]
                    )

    return run
