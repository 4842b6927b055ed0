"""Descriptive statistics, cross-tabulations, time series, n-grams and comparisons.

Results come in long form, one row per cell, so nothing grows with the number of columns; ``pivoted``
gives the wide form for display.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import tokens
from tesserae.session import kept, slim_batches

NULL, OTHER = "—", "Other"
FACETS = ("platform", "language", "country", "source_type", "source_dataset")
# Names of time steps.
STEPS = {"hour": "hour", "H": "hour", "day": "day", "D": "day", "week": "week", "W": "week", "month": "month", "M": "month", "MS": "month",
         "quarter": "quarter", "Q": "quarter", "QS": "quarter", "year": "year", "Y": "year", "YS": "year"}


def top_counts(df: DataFrame, column: str | Column, k: int = 10) -> DataFrame:
    """(value, n, share of non-null rows), ties by value."""
    c = F.col(column) if isinstance(column, str) else column
    counts = df.select(c.cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    shared = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return shared.orderBy(F.desc("n"), "value").limit(k)


def facets(df: DataFrame, k: int = 15, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, n): the top ``k`` of each column in one pass over the rows."""
    there = [c for c in columns if c in df.columns]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in there]))
    counts = df.select(cells.alias("c")).select("c.*").where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def exact_quantile(x: DataFrame, q: float, slack: float = 0.001) -> float | None:
    """The interpolated quantile ``q`` of the numbers ``x`` (one column of that name, no nulls).

    An approximate quantile on both sides brackets the place; only values within are counted and put in
    order, about ``slack`` of the rows and each value once, so no task holds all distinct values.
    """
    n, around = x.agg(F.count("*"), F.percentile_approx("x", F.array(F.lit(max(0.0, q - slack / 2)), F.lit(min(1.0, q + slack / 2))), F.lit(10_000))).first()
    if not n:
        return None
    below = F.sum((F.col("x") < around[0]).cast("long"))
    skipped = x.agg(below).first()[0]
    upto = F.sum("n").over(Window.orderBy("x"))
    near = x.where(F.col("x").between(*around)).groupBy("x").agg(F.count("*").alias("n")).select("x", (upto + skipped).alias("upto"))
    place = q * (n - 1)
    low, high = int(place), min(n - 1, int(place) + 1)
    a, b = near.agg(F.min(F.when(F.col("upto") > low, F.col("x"))), F.min(F.when(F.col("upto") > high, F.col("x")))).first()
    return a if b is None or place == low else a + (b - a) * (place - low)


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, median, sum, min and max of what can be read as a number."""
    x = df.select(F.col(column).try_cast("double").alias("x")).where("x IS NOT NULL")
    median = F.lit(exact_quantile(x, 0.5)).cast("double")
    return x.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), median.alias("median"), F.sum("x").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"))


def author_of(df: DataFrame) -> Column:
    """The first of handle, id and name that is not blank."""
    parts = [F.trim(F.col(c).cast("string")) for c in ("author_handle", "author_id", "author_name") if c in df.columns]
    return F.coalesce(*[F.when(p != "", p) for p in parts], F.lit(None).cast("string"))


def unique_authors(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct(author_of(df)).alias("authors"))


def date_coverage(df: DataFrame, column: str = "created_at") -> DataFrame:
    c = F.col(column)
    return df.agg(F.min(c).alias("first"), F.max(c).alias("last"), ((F.unix_micros(F.max(c)) - F.unix_micros(F.min(c))) / 86_400_000_000).alias("span_days"))


def top_authors_by(df: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """Authors by summed metric, with their share of the listed total."""
    sums = df.select(author_of(df).alias("author"), F.col(metric).try_cast("double").alias("x")).where("author IS NOT NULL").groupBy("author").agg(F.sum("x").alias("total"))
    listed = sums.where("total > 0").orderBy(F.desc("total"), "author").limit(k)
    return listed.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def first_metric(df: DataFrame, candidates: tuple[str, ...] = ("like_count", "share_count", "comment_count", "view_count")) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def text_length(df: DataFrame, column: str = "text") -> DataFrame:
    """Mean, median and 95th percentile of characters over rows that are not blank (the largest under 20 rows)."""
    x = df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").select(F.length(column).cast("double").alias("x"))
    median, p95 = (F.lit(exact_quantile(x, q)).cast("double") for q in (0.5, 0.95))
    return x.agg(F.count("*").alias("texts"), F.avg("x").alias("mean"), F.max(median).alias("median"), F.when(F.count("*") < 20, F.max("x")).otherwise(F.max(p95)).alias("p95"))


def _items(df: DataFrame, column: str) -> Column:
    return F.col(column) if dict(df.dtypes)[column].startswith("array") else F.split(F.col(column), r"[,\s]+")


def exploded(df: DataFrame, column: str) -> DataFrame:
    """Items of a list column, or of a string split at commas and spaces."""
    return df.select(F.explode(_items(df, column)).alias("item")).where("trim(item) <> ''")


def _quantile_cells(df: DataFrame, quantiles: list[tuple[str, Column, float]], slack: float) -> tuple[list[Column], dict[str, tuple]]:
    """Cells that place quantiles exactly, and (count, mean, sum, least, most, first, last) of each name from one scan.

    Sketches bracket every quantile; in the second scan a value within its bracket is a cell of its own, and
    one below is counted, so what is gathered is about ``slack`` of the rows, each value once.
    """
    names = list(dict.fromkeys(n for n, _, _ in quantiles))
    x = {n: c for n, c, _ in quantiles}
    ends = {n: sorted({max(0.0, q - slack / 2) for m, _, q in quantiles if m == n} | {min(1.0, q + slack / 2) for m, _, q in quantiles if m == n}) for n in names}
    asked = [F.struct(F.count(x[n]), F.avg(x[n]), F.sum(x[n]), F.min(x[n]), F.max(x[n]), F.percentile_approx(x[n], F.array(*map(F.lit, ends[n])), F.lit(10_000))).alias(f"q{i}") for i, n in enumerate(names)]
    told = dict(zip(names, df.agg(*asked).first() if asked else [], strict=True))
    cells = []
    for n, c, q in quantiles:
        if told[n][0]:
            low, high = (told[n][5][ends[n].index(e)] for e in (max(0.0, q - slack / 2), min(1.0, q + slack / 2)))
            inside = F.when(c.between(low, high), c)
            cells.append(F.when(c <= high, F.struct(F.lit(f"quantile:{n}:{q}").alias("section"), F.coalesce(inside.cast("string"), F.lit("")).alias("item"), inside.alias("x"))))
    return cells, told


def _placed(cells: DataFrame, name: str, q: float, n: int) -> Column | None:
    """The interpolated quantile from the cells of its bracket."""
    near = cells.where(F.col("section") == f"quantile:{name}:{q}").select("item", "n", (F.col("total") / F.col("n")).alias("x"))
    below = near.where("x IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    upto = near.where("x IS NOT NULL").select(F.col("item").try_cast("double").alias("x"), "n").withColumn("upto", F.sum("n").over(Window.orderBy("x")) + below)
    place = q * (n - 1)
    low, high = int(place), min(n - 1, int(place) + 1)
    a, b = upto.agg(F.min(F.when(F.col("upto") > low, F.col("x"))), F.min(F.when(F.col("upto") > high, F.col("x")))).first()
    return a if b is None or place == low else a + (b - a) * (place - low)


METRICS = ("like_count", "share_count", "comment_count", "view_count")
LISTS = ("hashtags", "mentions", "media_urls")


def descriptives(df: DataFrame, k: int = 10, slack: float = 0.001) -> dict[str, DataFrame]:
    """The parts of a corpus description from two scans of the rows.

    The first scan counts, sums and sketches all numbers; the second makes a cell of every value of every
    section, which one aggregate with a map-side part counts. All parts are read off the cells.
    """
    spark = df.sparkSession
    author, number = author_of(df), lambda c: F.col(c).try_cast("double")
    metrics, lists = [c for c in METRICS if c in df.columns], [c for c in LISTS if c in df.columns]
    chars = F.when(F.trim(F.coalesce(F.col("text"), F.lit(""))) != "", F.length("text").cast("double")) if "text" in df.columns else None
    wanted = [(c, number(c), 0.5) for c in metrics] + ([("chars", chars, 0.5), ("chars", chars, 0.95)] if chars is not None else [])
    dates = [("dates", F.unix_micros("created_at").cast("double"), 0.5)] if "created_at" in df.columns else []
    near, told = _quantile_cells(df, wanted + dates, slack)
    near = near[: len(near) - len(dates)] if dates and told["dates"][0] else near  # of dates only the ends are asked for
    cell = lambda section, item, x=None: F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"), (F.lit(None) if x is None else x).cast("double").alias("x"))
    one = [cell("rows", F.lit("rows")), F.when(author.isNotNull(), cell("authors", author, number(metrics[0]) if metrics else None))]
    one += [F.when(F.col(c).isNotNull(), cell(f"facet:{c}", F.col(c))) for c in FACETS if c in df.columns]
    listed = lambda c: F.transform(_items(df, c), lambda i: F.when(F.trim(i) != "", cell(f"list:{c}", i)))
    many = [listed(c) for c in lists]
    each = df.select(F.explode(F.concat(F.array(*one, *near), *[F.coalesce(m, F.array().cast("array<struct<section:string,item:string,x:double>>")) for m in many])).alias("c")).where("c IS NOT NULL")
    counted = kept(each.groupBy("c.section", "c.item").agg(F.count("*").alias("n"), F.sum("c.x").alias("total")), "cells")

    def top(section: str) -> DataFrame:
        return counted.where(F.col("section") == section).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "item").limit(k).select(F.col("item").alias("value"), "n", "share")

    rows = counted.where("section = 'rows'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    out = {"rows": rows, "authors": counted.where("section = 'authors'").agg(F.count("*").alias("authors")), "top_authors": top("authors")}
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "item"))
    facet = counted.where("section LIKE 'facet:%'").withColumn("rank", rank).where(F.col("rank") <= k)
    out["facets"] = facet.select(F.expr("substring(section, 7)").alias("facet"), F.col("item").alias("value"), "n", "rank")
    for c in metrics:
        n, mean, total, low, high, _ = told[c]
        row = [(n, mean, _placed(counted, c, 0.5, n) if n else None, total, low, high)]
        out[c] = spark.createDataFrame(row, "n long, mean double, median double, total double, low double, high double")
    if chars is not None:
        n, mean, _, _, high, _ = told["chars"]
        p95 = (high if n < 20 else _placed(counted, "chars", 0.95, n)) if n else None
        out["text_length"] = spark.createDataFrame([(n, mean, _placed(counted, "chars", 0.5, n) if n else None, p95)], "texts long, mean double, median double, p95 double")
    if dates:
        ends = spark.createDataFrame([(int(told["dates"][3]), int(told["dates"][4])) if told["dates"][0] else (None, None)], "a long, b long")
        out["dates"] = ends.select(F.timestamp_micros("a").alias("first"), F.timestamp_micros("b").alias("last"), ((F.col("b") - F.col("a")) / 86_400_000_000).alias("span_days"))
    if metrics:
        engaged = counted.where("section = 'authors' AND total > 0").orderBy(F.desc("total"), "item").limit(k)
        out["authors_by_engagement"] = engaged.select(F.col("item").alias("author"), "total", (F.col("total") / F.sum("total").over(Window.partitionBy())).alias("share"))
    return out | {c: top(f"list:{c}") for c in lists}


def described(df: DataFrame, k: int = 10) -> DataFrame:
    """(section, item, n, value): all parts of :func:`descriptives` as rows."""
    parts, out = descriptives(df, k), None
    for name, part in parts.items():
        number = {c for c, t in part.dtypes if t in ("bigint", "double")}
        if name in ("rows", "authors", "dates", "text_length") or name in METRICS:
            cells = [F.struct(F.lit(c).alias("item"), F.lit(None).cast("long").alias("n"), F.col(c).cast("double").alias("value")) for c in part.columns if c in number]
            rows = part.select(F.explode(F.array(*cells)).alias("c")).select(F.lit(name).alias("section"), "c.*")
        else:
            value = "total" if name == "authors_by_engagement" else "share" if "share" in part.columns else None
            section = F.concat(F.lit("facet:"), "facet") if name == "facets" else F.lit(name)
            rows = part.select(section.alias("section"), F.col("author" if name == "authors_by_engagement" else "value").alias("item"), (F.col("n") if "n" in part.columns else F.lit(None)).cast("long").alias("n"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def crosstab(df: DataFrame, row: str, col: str, normalize: str | None = None, top_rows: int = 25, top_cols: int = 25) -> DataFrame:
    """(row, col, value) for the top values of each axis; shares are of what is left after the cut."""
    cells = _cells(df, row, col, top_rows, top_cols)
    over = {"row": ["row"], "col": ["col"], "all": []}
    if normalize is None:
        return cells.select("row", "col", F.col("n").alias("value"))
    return cells.select("row", "col", (F.col("n") / F.sum("n").over(Window.partitionBy(*over[normalize]))).alias("value"))


def _cells(df: DataFrame, row: str, col: str, top_rows: int, top_cols: int) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    cells = df.groupBy(name(row).alias("row"), name(col).alias("col")).agg(F.count("*").alias("n"))
    for axis, k in (("row", top_rows), ("col", top_cols)):
        best = cells.groupBy(axis).agg(F.sum("n").alias("m")).orderBy(F.desc("m"), axis).limit(k).select(axis)
        cells = cells.join(F.broadcast(best), axis, "left_semi")  # k values at most
    return cells


def crosstab_margins(df: DataFrame, row: str, col: str, top_rows: int = 25, top_cols: int = 25) -> DataFrame:
    """(axis, value, n, truncated): totals of rows, columns and all after the cut, and whether the axis was cut."""
    cells = _cells(df, row, col, top_rows, top_cols)
    made = [cells.groupBy(F.lit(a).alias("axis"), F.col(a).alias("value")).agg(F.sum("n").alias("n")) for a in ("row", "col")]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    kinds = df.agg(F.count_distinct(name(row)).alias("rows"), F.count_distinct(name(col)).alias("cols"))
    total = cells.agg(F.lit("all").alias("axis"), F.lit("all").alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    cut = F.when(F.col("axis") == "row", F.col("rows") > top_rows).when(F.col("axis") == "col", F.col("cols") > top_cols).otherwise((F.col("rows") > top_rows) | (F.col("cols") > top_cols))
    return made[0].unionByName(made[1]).unionByName(total).crossJoin(F.broadcast(kinds)).select("axis", "value", "n", cut.alias("truncated"))  # one row


def pivoted(cells: DataFrame, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    return cells.groupBy(row).pivot(col).agg(F.first(value)).na.fill(0)


def bucket(c: Column, step: str) -> Column:
    """The start of a time step as text; weeks are named by the Sunday they end on."""
    unit = STEPS.get(step, step)
    start = F.date_trunc(unit, c)
    if unit == "week":
        start = start + F.expr("INTERVAL 6 DAYS")
    return F.date_format(start, "yyyy-MM-dd HH:mm" if unit == "hour" else "yyyy-MM-dd")


def timeseries(df: DataFrame, step: str = "day", group: str | None = None, k: int = 8, agg: str = "count", value: str | None = None, date: str = "created_at") -> DataFrame:
    """(bucket, grp, value); groups beyond the top ``k`` are one, and only buckets with rows appear.

    Values that are no number count as 0 in sums and means.
    """
    x = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0)) if value else F.lit(1.0)
    name = F.coalesce(F.col(group).cast("string"), F.lit(NULL)) if group else F.lit("all")
    rows = df.where(F.col(date).isNotNull()).select(bucket(F.col(date), step).alias("bucket"), name.alias("grp"), x.alias("x"))
    cells = rows.groupBy("bucket", "grp").agg(F.count("*").alias("n"), F.sum("x").alias("s"))  # before the cut: rows once
    if group:
        best = cells.groupBy("grp").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "grp").limit(k).select(F.col("grp").alias("best"))
        met = cells.join(F.broadcast(best), F.col("grp") == F.col("best"), "left")
        cells = met.groupBy("bucket", F.coalesce("best", F.lit(OTHER)).alias("grp")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = {"count": F.col("n"), "sum": F.col("s"), "mean": F.col("s") / F.col("n")}[agg]
    return cells.select("bucket", "grp", out.alias("value"))


#: Buckets that n-grams are first counted in, and words of a block of texts whose n-grams are counted together.
BUCKETS, BLOCK = 1 << 20, 4_000_000


def ngrams(df: DataFrame, n: int = 1, k: int = 50, min_count: int = 1, stop: list[str] | None = None, column: str = "text") -> DataFrame:
    """(gram, n, docs, doc_share): stopwords go before grams are made.

    A first pass counts all occurrences in buckets by hash, and the grams of each block's fullest buckets; the ``k``-th of
    these, summed, bounds the count of the ``k``-th gram from below. A gram of a bucket below that bound cannot be listed,
    so the second pass counts the others only, and these exactly: little is shuffled, whatever the texts.
    """
    k, n = min(200, max(1, k)), min(3, max(1, n))
    texts, spark = df.where(F.col(column).isNotNull()), df.sparkSession
    slim_batches(spark)
    worded = texts.select(tokens(F.col(column)).alias("words"))
    first = kept(worded.mapInArrow(_grams(n, stop, k, None), "gram string, bucket int, n long").groupBy("gram", "bucket").agg(F.sum("n").alias("n")), "buckets")
    best = [r.n for r in first.where("gram IS NOT NULL").orderBy(F.desc("n")).limit(k).select("n").collect()]
    least = max(min_count, best[-1] if len(best) == k else 1)
    full = np.zeros(BUCKETS, bool)
    full[[r.bucket for r in first.where((F.col("gram").isNull()) & (F.col("n") >= least)).select("bucket").collect()]] = True  # of BUCKETS at most
    each = worded.mapInArrow(_grams(n, stop, k, spark.sparkContext.broadcast(full)), "gram string, n long, docs long")
    counts = each.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("n") >= min_count)
    total = texts.agg(F.count("*").alias("_t"))
    listed = counts.orderBy(F.desc("n"), "gram").limit(k)
    return listed.crossJoin(F.broadcast(total)).select("gram", "n", "docs", (F.col("docs") / F.col("_t")).alias("doc_share"))  # one row


def _grams(n: int, stop: list[str] | None, k: int, full: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, filled = [], 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held.append(batch.column(0))
            words += len(batch.column(0).flatten())
            if words >= BLOCK:
                yield from _block_grams(held, n, stop, k, full, filled)
                held, words = [], 0
        if words:
            yield from _block_grams(held, n, stop, k, full, filled)
        at = np.flatnonzero(filled)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(filled[at])], names=["gram", "bucket", "n"])

    return run


def _block_grams(held: list[pa.Array], n: int, stop: list[str] | None, k: int, full: Broadcast | None, filled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds a block's n-grams to the counts of their buckets and gives those of the ``k`` fullest; or counts those of full buckets."""
    lists = pa.concat_arrays(held)
    said = lists.flatten().dictionary_encode()
    word, text = said.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if stop:
        stays = ~pc.is_in(said.dictionary, pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)[word]
        word, text = word[stays], text[stays]
    own = pd.util.hash_array(said.dictionary.to_numpy(zero_copy_only=False))
    start = np.flatnonzero(text[n - 1 :] == text[: max(0, len(text) - n + 1)])
    hashed = np.zeros(len(start), np.uint64)
    for i in range(n):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + own[word[start + i]]
    bucket = ((hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).astype(np.int64)
    if full is None:
        mine = np.bincount(bucket, minlength=BUCKETS)
        filled += mine
        chosen = np.zeros(BUCKETS, bool)
        chosen[np.argpartition(mine, -k)[-k:]] = True
    else:
        chosen = full.value
    start = start[chosen[bucket]]
    if not len(start):
        return
    number = word[start]
    for i in range(1, n):
        number = np.unique(number, return_inverse=True)[1] * len(said.dictionary) + word[start + i]
    _, place, number = np.unique(number, return_index=True, return_inverse=True)
    names = [said.dictionary.take(pa.array(word[start[place] + i])) for i in range(n)]
    gram = pc.binary_join_element_wise(*names, " ") if n > 1 else names[0]
    times = np.bincount(number)
    if full is None:
        yield pa.RecordBatch.from_arrays([gram, pa.nulls(len(gram), pa.int32()), pa.array(times)], names=["gram", "bucket", "n"])
    else:
        once = np.unique(number * len(lists) + text[start]) // len(lists)
        yield pa.RecordBatch.from_arrays([gram, pa.array(times), pa.array(np.bincount(once))], names=["gram", "n", "docs"])


def key_figures(df: DataFrame, counts: tuple[str, ...] = ("like_count", "share_count", "comment_count", "view_count")) -> DataFrame:
    """(metric, value) rows: rows, authors and means of the counts there are."""
    wide = df.agg(
        F.count("*").cast("double").alias("rows"), F.countDistinct(author_of(df)).cast("double").alias("authors"),
        *[F.avg(F.col(c).try_cast("double")).alias(f"mean_{c}") for c in counts if c in df.columns],
    )
    return wide.select(F.explode(F.create_map(*[x for c in wide.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, diff, relative); the last is null where a is 0 or null."""
    met = key_figures(a).withColumnRenamed("value", "a").join(key_figures(b).withColumnRenamed("value", "b"), "metric", "full")
    return met.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("diff"), F.try_divide(F.col("b") - F.col("a"), F.nullif(F.col("a"), F.lit(0.0))).alias("relative"))


def column_profile(df: DataFrame, floor: int = 200, share: float = 0.2) -> DataFrame:
    """(name, kind, distinct, categorical) of every column, from one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_distinct(F.col(c).cast("string")).alias(c) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))])
    names = [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("kind"), F.col(c).alias("distinct")) for c, t in names]))
    out = counts.select("_n", cells.alias("c")).select("c.*", "_n")
    return out.withColumn("categorical", (F.col("distinct") >= 1) & (F.col("distinct") <= F.greatest(F.lit(floor), share * F.col("_n")))).drop("_n")


def corpus_features(df: DataFrame, column: str = "text", k: int = 20) -> dict[str, DataFrame]:
    """Lengths, rows with media, and the most frequent emojis, hashtags and domains."""
    from tesserae.functions.text import domains, emojis, hashtags

    c = F.col(column)
    n = F.length(F.coalesce(c, F.lit(""))).cast("double")
    lists = {"emojis": emojis(c), "hashtags": F.slice(hashtags(c), 1, 20), "domains": F.slice(domains(c), 1, 10)}
    media = [F.col(m).isNotNull() & (F.size(m) > 0 if t.startswith("array") else F.trim(m) != "") for m, t in df.dtypes if m in ("media_url", "media_urls")]
    shown = F.lit(False)
    for m in media:
        shown = shown | F.coalesce(m, F.lit(False))
    median, p90 = (F.lit(exact_quantile(df.select(n.alias("x")), q)).cast("double") for q in (0.5, 0.9))
    out = {"lengths": df.agg(F.sum(shown.cast("long")).alias("with_media"), F.avg(n).alias("mean"), F.max(median).alias("median"), F.max(p90).alias("p90"))}
    return out | {name: top_counts(df.select(F.explode(items).alias("item")), "item", k) for name, items in lists.items()}


#: Columns that make no strata.
NO_STRATA = ("post_id", "text", "url", "author_id", "in_reply_to", "parent_id", "_row_idx")


def stratification_candidates(df: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(name, distinct) of the columns that samples can be stratified by: not numeric, 2 to 50 values."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "timestamp", "date")
    names = [c for c, t in df.dtypes if c not in NO_STRATA and not t.startswith(numeric)]
    return column_profile(df.select(*names)).where(F.col("distinct").between(least, most)).select("name", "distinct") if names else column_profile(df).limit(0).select("name", "distinct")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def language_counts(df: DataFrame, k: int = 20) -> DataFrame:
    return top_counts(df, "language", k)
