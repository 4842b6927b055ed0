"""Datasets to one corpus: mapped, dated, united, deduplicated and numbered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import text_hash
from tesserae.operators.sampling import numbered
from tesserae.schema import apply_mapping
from tesserae.session import kept, slim_batches

# Date shapes that are tried in turn.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssX", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss'Z'", "yyyy/MM/dd",
)
DAY_FIRST = ("d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy")
MONTH_FIRST = ("M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy")
SHAPE = r"^\s*(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}"


#: Where a row stands: its dataset, file, part of the file, and place in the part.
ORDER = ("_set", "_file", "_part", "_line")


def is_day_first(df: DataFrame, column: str, rows: int = 200, order: tuple[str, ...] = ()) -> bool:
    """Whether at least 15 % of up to 200 numeric dates, the first by ``order``, can only have the day in front.

    Without an order those of the least hash count, so that the answer never depends on how rows are dealt out.
    """
    told = df.select(F.col(column).cast("string").alias("d"), *order).where("d IS NOT NULL")
    some = told.orderBy(*(order or [F.xxhash64("d")]), "d").limit(rows)
    parts = some.where(F.col("d").rlike(SHAPE)).select(F.regexp_extract("d", SHAPE, 1).cast("int").alias("a"), F.regexp_extract("d", SHAPE, 2).cast("int").alias("b"))
    share = parts.agg(F.avg(((F.col("a") > 12) & (F.col("b") <= 12)).cast("int"))).first()[0]
    return share is not None and share >= 0.15


def parsed_date(c: Column, day_first: bool = False) -> Column:
    """A timestamp from any known shape, or from epoch seconds or milliseconds; else null."""
    t = F.trim(c.cast("string"))
    epoch = t.try_cast("double")
    seconds = F.when(t.rlike(r"^\d{9,11}(\.\d+)?$"), epoch).when(t.rlike(r"^\d{12,14}$"), epoch / 1000)
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in (*FORMATS, *(DAY_FIRST if day_first else MONTH_FIRST), *(MONTH_FIRST if day_first else DAY_FIRST))]
    named = F.when(t.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d"), F.try_to_timestamp(F.substring(t, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy")))
    return F.coalesce(F.timestamp_seconds(seconds), *tries, named)


@dataclass(frozen=True)
class Dataset:
    name: str
    rows: DataFrame
    mapping: dict[str, str]
    source_id: str = "generic"
    defaults: dict[str, str] | None = None


def united(datasets: list[Dataset]) -> DataFrame:
    """Canonical rows of all datasets with their origin and place (``ORDER``).

    A part of a file is read by one task from its start, so file, part and place in it give the order of
    the file however its parts are dealt out. Rows that come from no file stand in their task's order.
    """
    out = None
    for k, d in enumerate(datasets):
        placed = d.rows.select("*", F.input_file_name().alias("_file"), F.expr("input_file_block_start()").alias("_part"), F.monotonically_increasing_id().alias("_line"))
        one = apply_mapping(placed, d.mapping, d.defaults, keep=("_file", "_part", "_line"))
        dated = one.withColumn("created_at", parsed_date(F.col("created_at"), is_day_first(one, "created_at", order=ORDER[1:])))
        part = dated.select("*", F.lit(d.name).alias("source_dataset"), F.lit(d.source_id).alias("source_id"), F.lit(k).alias("_set"))
        out = part if out is None else out.unionByName(part)
    return out


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key; rows without a key all stay.

    The key is computed once, into a slim table of keys and places. Its first rows come from an aggregate
    with a map-side part, so a key that most rows share never has its rows gathered in one task; the
    others are taken out of ``df`` by their places alone.
    """
    slim = kept(df.select(key.alias("_key"), *order).where("_key IS NOT NULL"), "keys")
    first = slim.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    winners = first.select(*[F.col("_first")[o].alias(o) for o in order])
    gone = slim.select(*order).join(winners, list(order), "left_anti")
    return df.join(gone, list(order), "left_anti")


def id_key(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def dedupe_exact(df: DataFrame, *order: str, key: str = "post_id") -> DataFrame:
    return keep_first(df, id_key(F.col(key)), *order)


def dedupe_near(df: DataFrame, *order: str, key: str = "text", compose: bool = True) -> DataFrame:
    slim_batches(df.sparkSession)  # long texts may go to Python
    return keep_first(df, text_hash(F.col(key), compose), *order)


def build_corpus(datasets: list[Dataset], exact: bool = True, near: bool = True) -> DataFrame:
    """The corpus with ``_row_idx``, 0-based in file order."""
    rows = kept(united(datasets), "united")  # places are numbered once
    rows = dedupe_exact(rows, *ORDER) if exact else rows
    rows = dedupe_near(rows, *ORDER) if near else rows
    bucket = F.struct("_set", "_file", "_part", F.shiftright("_line", 33))  # a part of a file
    return numbered(rows, bucket, *ORDER).withColumn("_row_idx", F.col("_n").cast("long")).drop("_n", *ORDER)


def merge_stats(rows: DataFrame, *order: str, compose: bool = True) -> DataFrame:
    """rows_in, exact and near duplicates removed, and rows_out, in one row."""
    once = dedupe_exact(rows, *order)
    twice = dedupe_near(once, *order, compose=compose)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(rows, "rows_in").crossJoin(n(once, "_once")).crossJoin(n(twice, "rows_out"))  # one row each
    return counts.select("rows_in", (F.col("rows_in") - F.col("_once")).alias("exact_removed"), (F.col("_once") - F.col("rows_out")).alias("near_removed"), "rows_out")


def quality_flags(df: DataFrame) -> DataFrame:
    """Blank texts, repeated ids (nulls are one id) and dates that can't be read, in one pass."""
    text, pid = F.col("text"), F.col("post_id").cast("string")
    bad = F.col("created_at").isNotNull() & parsed_date(F.col("created_at")).isNull() if "created_at" in df.columns else F.lit(False)
    return df.agg(
        F.sum((text.isNull() | (F.trim(text) == "")).cast("long")).alias("blank_text"),
        (F.count("*") - F.countDistinct(pid) - F.max(pid.isNull().cast("long"))).alias("duplicate_ids"),
        F.sum(bad.cast("long")).alias("bad_dates"),
    )


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
