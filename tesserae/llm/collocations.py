"""Phrase collocations, mined per language from deduplicated pieces.

A text is cut at sentence marks and line ends into pieces, a piece at blanks into words. A phrase is
two to five neighbouring words of one piece. Its score is the lowest, over all cuts into two parts,
of how much more often the parts meet than chance lets them.

1. Equal pieces become one row with a multiplicity (Spark, combined on the map side), so copies
   and boilerplate cost one row however often they occur.
2. Weighted n-grams are counted level by level. A task counts the n-grams of a few megabytes of
   pieces in numpy, a shuffle deals them to hash buckets, and each bucket is summed exactly by DuckDB
   out-of-core under a fixed memory limit. An n-gram is only counted where both of its (n-1)-grams are
   frequent, which a Bloom filter of bounded size tells: it has no false negatives, so no frequent
   phrase is lost, and what it lets through by mistake is counted and found infrequent.
3. Every cut of a candidate asks for the counts of both parts: requests are shuffled to where the
   parts' counts lie and the answers are put together per candidate. Parts of a frequent phrase are
   frequent, so each request is met.
4. Candidates that stand inside a longer one which (nearly) always surrounds them go; the best of
   each language are ranked.

Products of counts are decimals of 38 digits, so scores are exact.

DuckDB spills to the shared folder where that is a file system; elsewhere it keeps to its memory limit
and fails, and more shuffle partitions make buckets smaller.

Odd rows: null texts are empty, null lang is ``und``; empty pieces are none. Each row counts, repeated
rows and repeated doc_ids too. A text of any length is one row of pieces. Extra columns are ignored. An
empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, words
from .repeats import _places

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a phrase at most; occurrences at least; percent of occurrences at which a longer phrase covers a shorter; ranks.
LONGEST, LEAST, COVER, BEST = 5, 100, 100, 2000
#: Bytes of pieces that a task counts at once, and DuckDB's memory for a bucket.
CHUNK, MEMORY = 8_000_000, "256MB"


def pieces(docs: DataFrame) -> DataFrame:
    """Distinct pieces per language: lang, piece (words joined by one blank), m (how often), size (words)."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    cut = shared.document_columns(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    plain = cut.select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).where("piece <> ''")
    many = plain.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))
    return many.withColumn("size", F.length("piece") - F.length(F.translate("piece", " ", "")) + 1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some ``CHUNK`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _language(langs: pa.Array) -> np.ndarray:
    """A hash per row of its language."""
    import xxhash

    told = langs.dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(x) for x in told.dictionary.to_pylist()], np.uint64)
    return each[told.indices.to_numpy()]


def _groups(key: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Representatives and group numbers of equal rows of ``parts``, found by their hash ``key`` and verified."""
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    if any((p != p[first][group]).any() for p in parts):  # two hashes met: by the rows themselves
        _, first, group = np.unique(np.stack(parts, 1), axis=0, return_index=True, return_inverse=True)
    return first, group.reshape(-1)


def _grams(rows: DataFrame, n: int, sieves: list[shared.Sieve]) -> DataFrame:
    """n-grams (lang, phrase, f) summed within chunks of pieces, where all shorter parts may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(shared.slices(batches, 1, CHUNK)):
            w = words.split(batch.column(1))
            row = w.text_of()
            hashes, lang = w.hashes(), _language(batch.column(0))[row]
            ok = np.ones(len(hashes), bool)  # whether the k-gram from here on may be frequent
            for k, sieve in enumerate(sieves, 1):
                at = np.flatnonzero(ok)
                key = words.mix(words.runs(hashes, k)[at] ^ lang[at])
                ok[at] = sieve.test([pa.array(p) for p in _places(key, sieve.bits)])
                ok = ok[:-1] & ok[1:] & (row[: len(ok) - 1] == row[k : len(ok) - 1 + k])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            runs = words.runs(hashes, n)[at]
            told = batch.column(0).dictionary_encode()
            tongue = told.indices.to_numpy()[row[at]]
            first, group = _groups(words.mix(runs ^ lang[at]), [tongue, *(hashes[at + j] for j in range(n))])
            m = np.zeros(len(first), np.int64)
            np.add.at(m, group, batch.column(2).to_numpy()[row[at]])
            begin, end = w.start[at[first]], w.end[at[first] + n - 1]
            size = end - begin
            ends = np.concatenate([[0], np.cumsum(size)])
            data = w.data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
            phrase = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
            langs = told.dictionary.take(pa.array(tongue[first]))
            yield pa.RecordBatch.from_arrays([langs, phrase, pa.array(m)], names=["lang", "phrase", "f"])

    shared.small_batches(rows.sparkSession)
    return rows.select("lang", "piece", "m").mapInArrow(run, "lang string, phrase string, f long")


def _spill(spark: SparkSession) -> str | None:
    """Where DuckDB may spill: the shared folder, if it is a file system's."""
    path = shared.fresh_path(spark, "duckdb")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def _summed(rows: DataFrame, least: int, memory: str = MEMORY) -> DataFrame:
    """Sums of f per (lang, phrase) of ``least`` and more: one DuckDB aggregation per hash bucket."""
    spill = _spill(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
        own = spill and f"{spill}/{uuid.uuid4().hex}"
        con = duckdb.connect(config={"memory_limit": memory, "threads": 1, "preserve_insertion_order": "false", "temp_directory": own or ""})
        try:
            grams = pa.RecordBatchReader.from_batches(kind, (b.cast(kind) for b in batches))  # noqa: F841  DuckDB reads it by its name
            done = con.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM grams GROUP BY lang, phrase HAVING sum(f) >= {int(least)}")
            yield from done.to_arrow_reader(50_000)
        finally:
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    return rows.repartition("lang", "phrase").mapInArrow(run, "lang string, phrase string, f long")


def _keys(counts: DataFrame, n: int) -> DataFrame:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            key = words.runs(words.split(batch.column(1)).hashes(), n)[::n]
            return pa.RecordBatch.from_arrays([pa.array(words.mix(key ^ _language(batch.column(0))).view(np.int64))], names=["h"])

        return work

    return shared.arrow_map(counts.select("lang", "phrase"), "h long", make)


def count_phrases(many: DataFrame, least: int = LEAST, longest: int = LONGEST, memory: str = MEMORY) -> DataFrame:
    """All phrases of up to ``longest`` words that occur ``least`` times: lang, n, phrase, f; ``many`` are pieces."""
    levels, sieves = [], []
    for n in range(1, longest + 1):
        if n > 1:
            sieves.append(shared.sieve(_keys(levels[-1], n - 1), "h"))
        found = shared.stored(_summed(_grams(many.where(F.col("size") >= n), n, sieves), least, memory), f"grams-{n}")
        levels.append(found)
        if found.isEmpty():
            break
    out = levels[0].withColumn("n", F.lit(1))
    for n, level in enumerate(levels[1:], 2):
        out = out.unionByName(level.withColumn("n", F.lit(n)))
    return out


def _joined(w: str, start: str, count: str) -> str:
    return f"array_join(slice({w}, {start}, {count}), ' ')"


def score(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Per phrase of two words and more its lowest cut: lang, phrase, words (number), a, l, r, n, score."""
    asked = counts.where("n >= 2").selectExpr("lang", "phrase", "n as words", "f as a", "split(phrase, ' ') as w", "explode(sequence(1, n - 1)) as k")
    sides = asked.selectExpr(
        "lang", "phrase", "words", "a", "k",
        f"inline(array(struct('l' as side, {_joined('w', '1', 'k')} as part), struct('r' as side, {_joined('w', 'k + 1', 'words - k')} as part)))",
    )
    answers = sides.join(counts.selectExpr("lang", "phrase as part", "f"), ["lang", "part"])
    cuts = answers.groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.expr("if(side = 'l', f, null)")).alias("l"), F.max(F.expr("if(side = 'r', f, null)")).alias("r"))
    told = cuts.join(F.broadcast(totals) if totals.count() <= shared.FEW else totals, "lang")
    exact = "(1000 * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    scored = told.withColumn("score", F.expr(exact))
    low = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return low.select("lang", "phrase", "words", "a", "x.l", "x.r", "n", "x.score")


def uncovered(found: DataFrame, cover: int = COVER) -> DataFrame:
    """Without phrases that lie inside a longer one which occurs ``cover`` percent as often or more."""
    spans = found.where("words >= 3").selectExpr("lang", "a", "words", "split(phrase, ' ') as w", "explode(sequence(2, words - 1)) as size")
    inner = spans.selectExpr("lang", "a", "w", "size", "explode(sequence(1, words - size + 1)) as i").selectExpr("lang", f"{_joined('w', 'i', 'size')} as phrase", "a as longer")
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = found.join(most, ["lang", "phrase"], "left")
    return held.where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, best: int = BEST) -> DataFrame:
    """The ``best`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    many = shared.stored(pieces(docs), "pieces")
    totals = many.groupBy("lang").agg(F.sum(F.col("m") * F.col("size")).alias("n"))
    counts = count_phrases(many, least, longest)
    found = shared.stored(uncovered(shared.stored(score(counts, totals), "scores"), cover), "collocations")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, w, count(*)::HUGEINT AS m FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0 GROUP BY ALL),
t AS (SELECT lang, sum(len(w) * m)::HUGEINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, m, z, unnest(range(1, len(w) - z + 2)) AS i FROM (SELECT lang, w, m, unnest(range(1, 6)) AS z FROM w)),
g AS (SELECT lang, z, array_to_string(w[i:i + z - 1], ' ') AS phrase, sum(m)::HUGEINT AS f FROM i GROUP BY ALL HAVING sum(m) >= 100),
c AS (SELECT lang, z, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE z >= 2),
k AS (SELECT *, unnest(range(1, z)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.z, k.w, a, k, x.f AS l, y.f AS r, t.n, 1000 * a * t.n // (x.f * y.f) AS score FROM k JOIN t ON t.lang = k.lang
  JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k + 1:k.z], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
j AS (SELECT lang, a, w, y, unnest(range(1, z - y + 2)) AS i FROM (SELECT lang, a, w, z, unnest(range(2, z)) AS y FROM c)),
d AS (SELECT lang, array_to_string(w[i:i + y - 1], ' ') AS phrase, max(a) AS longer FROM j GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM b LEFT JOIN d USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""
