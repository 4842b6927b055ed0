"""Mixing sources to target weights by Pareto order sampling.

1. Each source's target: its share by weight of ``share`` times all words, at most ``most`` times its
   own words; what is above is shared out again by weight. The fill level is found in closed form
   from one row per source, so nothing iterates.
2. A document expects ``target / source words`` copies, times its own weight if one is given. Whole
   copies are certain; what is left is its inclusion probability.
3. Pareto order sampling fills the rest: documents are ranked by random odds divided by inclusion
   odds, and the first ones are taken until the words still wanted are used up. What is left of a
   source's target is filled, in the same ranking, from the documents that are short enough for it,
   and closed by the one document that brings the sum nearest to the target, if any does.

The running sums are cut in two levels: words per source and rank bin, then a ranking within the
one bin of a source where its sum passes the target. So a source with most of the rows is nowhere
sorted or gathered as a whole. Random numbers come from the key's MD5, hence reruns agree.

Null and empty texts have no words and are never taken. A null source is a source of its own. Rows
that repeat a key share its random number and are ordered by size. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (5, 2, 1)
SHARE, MOST, FILLS, SEED = 1.5, 2, 2, "mix"
#: Rank bins to each unit of the log odds, which are spread alike whatever the inclusion odds are.
BINS = 256


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sized(docs: DataFrame, weight: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, source, size in words, its own weight and the columns to carry."""
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(f"[^{shared.SPACE}]+")).cast("long")
    own = docs[weight].cast("double") if weight else F.lit(1.0)
    return docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), own.alias("own"), *carry)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From rows (source, source_size): source_rank, source_size, target. One small row per source.

    With sources in the order of cap / weight, all before the first whose cap holds the level
    ``(total - caps before) / weights from here on`` get their caps, the others level times weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("source_rank", F.row_number().over(order)).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") - 1) % len(weights) + 1)
    )
    capped = weighed.withColumn("cap", most * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    along = Window.orderBy("r", "source_rank")
    before = F.coalesce(F.sum("cap").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(along.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(share)
    leveled = capped.withColumn("level", (total - before) / after)
    level = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "source_rank", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))
    return leveled.select("source", "source_rank", "source_size", target.alias("target"))


def _take(rows: DataFrame, room: DataFrame, sources: int) -> DataFrame:
    """``rows`` (rank, v, size, open, ...) with ``took``: the open rows, by v, that fit each source's room.

    ``room`` has one row per source: source_rank and room; there are ``sources`` of them.
    """
    binned = rows.withColumn("bin", F.when(F.col("open"), F.floor(F.log("v") * BINS)))
    sums = binned.where("open").groupBy("source_rank", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source_rank").orderBy("bin"))
    reached = sums.withColumn("upto", upto).join(room, "source_rank").where(F.col("upto") > F.col("room"))
    edge = reached.groupBy("source_rank").agg(F.min(F.struct("bin", (F.col("room") - F.col("upto") + F.col("words")).alias("left"))).alias("e"))
    met = binned.join(shared.small(edge.select("source_rank", F.col("e.bin").alias("edge"), F.col("e.left").alias("left")), sources), "source_rank", "left")
    on_edge = F.col("open") & F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))
    clear = met.where(~on_edge).withColumn("took", F.col("open") & (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))))
    along = F.sum("size").over(Window.partitionBy("source_rank").orderBy("v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    split = met.where(on_edge).withColumn("took", along <= F.col("left"))
    return clear.unionByName(split).drop("bin", "edge", "left")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, weight: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, and the slim columns to carry."""
    slim = shared.stored(sized(docs, weight, carry), "sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("own")).alias("own_size"))
    wanted = shared.stored(targets(sums.select("source", "source_size"), weights, share, most).join(sums.select(F.col("source").alias("s"), "own_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    sources = wanted.count()
    placed = slim.join(shared.small(wanted.withColumnRenamed("source", "s"), sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = ratio if weight is None else F.least(F.lit(float(most)), ratio * F.col("own") * F.col("source_size") / F.greatest(F.col("own_size"), F.lit(1e-300)))
    shared_out = placed.withColumn("expected", copies).withColumn("whole", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("whole")
    u = F.col("u")
    ranked = shared_out.withColumn("p", p).withColumn("u", uniform(F.col("doc_id"), seed))
    odds = (u / (1.0 - u)) * ((1.0 - F.col("p")) / F.col("p"))
    rows = ranked.select(
        "doc_id", "source", "size", "source_rank", "source_size", "target", "whole", *carry,
        F.when(F.col("p") > 0, odds).otherwise(float("inf")).alias("v"),
        ((F.col("p") > 0) & (F.col("size") > 0) & (F.col("whole") < most)).alias("able"),
    ).withColumn("open", F.col("able"))
    certain = rows.groupBy("source_rank").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("room"))
    now = shared.stored(_take(rows, certain, sources).withColumn("copies", F.col("whole") + F.col("took").cast("long")), "mix")
    for _ in range(FILLS):
        gap = _gaps(now)
        again = now.drop("took").join(shared.small(gap, sources), "source_rank").withColumn("open", F.col("able") & (F.col("copies") == F.col("whole")) & (F.col("size") <= F.col("gap"))).drop("gap")
        filled = _take(again, gap.select("source_rank", F.col("gap").alias("room")), sources).withColumn("copies", F.col("copies") + F.col("took").cast("long"))
        old, now = now, shared.stored(filled, "mix")
        shared.dropped(docs.sparkSession, old)
    closed = _close(now, sources)
    return closed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def chosen(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, ``copies`` and the words ``taken``.

    Rows with one key, source and text are one document here: it is returned once, with the copies
    taken of all of them. Documents that the mix leaves out, and those without words, are not returned. Columns of ``docs`` that
    are called ``copies`` or ``taken`` give way.
    """
    own = docs.drop("copies", "taken")
    marked = own.withColumn("mix_text", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    plan = mix(marked.select("doc_id", "text", "source", "mix_text", *([options["weight"]] if options.get("weight") else [])), carry=("mix_text",), **options)
    key = ["doc_id", "source", "mix_text"]
    each = plan.groupBy(*key).agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.count("*").alias("mix_rows")).where("taken > 0")
    each = each.toDF("mix_id", "mix_source", "mix_hash", "copies", "taken", "mix_rows")
    same = F.col("doc_id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_text") == F.col("mix_hash"))
    met = marked.join(each, same)
    once = met.where("mix_rows = 1").unionByName(met.where("mix_rows > 1").dropDuplicates(["mix_id", "mix_source", "mix_hash"]))
    return once.select(*own.columns, "copies", "taken")


def _gaps(now: DataFrame) -> DataFrame:
    return now.groupBy("source_rank").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))


def _close(now: DataFrame, sources: int) -> DataFrame:
    """One more document per source if that brings its words nearer to the target, the nearest one."""
    gap = _gaps(now)
    last = F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "v", "doc_id", "size")
    able = F.col("able") & (F.col("copies") == F.col("whole")) & (F.abs(F.col("gap") - F.col("size")) < F.col("gap"))
    best = now.join(shared.small(gap, sources), "source_rank").where(able).groupBy("source_rank").agg(F.min(last).alias("best")).select("source_rank", "best.v", "best.doc_id", "best.size")
    best = best.toDF("b_rank", "b_v", "b_id", "b_size")
    same = (F.col("source_rank") == F.col("b_rank")) & (F.col("v") == F.col("b_v")) & F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("size") == F.col("b_size"))
    met = now.join(shared.small(best, sources), F.col("source_rank") == F.col("b_rank"), "left").withColumn("same", F.coalesce(same & F.col("able") & (F.col("copies") == F.col("whole")), F.lit(False)))
    # Rows that repeat the chosen one are told apart by a number; no other row is ranked.
    nth = F.row_number().over(Window.partitionBy("source_rank").orderBy("doc_id"))
    chosen = met.where("same").withColumn("copies", F.col("copies") + (nth == 1).cast("long"))
    return met.where("not same").unionByName(chosen)


#: DuckDB SQL for the query's rows, its ranking in one window per source.
ORACLE_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {{documents}}
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank FROM sizes GROUP BY source
), capped AS (
  SELECT *, [5, 2, 1][(source_rank - 1) % 3 + 1] AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM src
), leveled AS (
  SELECT *, cap / w AS r,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped
), targets AS (
  SELECT source, source_rank, source_size, least(cap, (SELECT arg_min(level, (r, source_rank)) FROM leveled WHERE level <= r) * w) AS target FROM leveled
), placed AS (
  SELECT s.*, t.source_rank, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected,
    (CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({1 << 52} AS DOUBLE) AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), odds AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM placed
), ranked AS (
  SELECT *, (u / (1 - u)) * ((1 - p) / nullif(p, 0)) AS q, p > 0 AND size > 0 AND whole < 2 AS open FROM odds
), v AS (
  SELECT *, CASE WHEN p > 0 THEN q ELSE CAST('Infinity' AS DOUBLE) END AS v, target - sum(whole * size) OVER (PARTITION BY source_rank) AS room FROM ranked
), one AS (
  SELECT *, whole + CASE WHEN open AND sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY source_rank ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING) <= room THEN 1 ELSE 0 END AS copies FROM v
), gap1 AS (
  SELECT *, target - sum(copies * size) OVER (PARTITION BY source_rank) AS gap FROM one
), open1 AS (
  SELECT *, open AND copies = whole AND size <= gap AS fits FROM gap1
), two AS (
  SELECT * REPLACE (copies + CASE WHEN fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source_rank ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap THEN 1 ELSE 0 END AS copies) FROM open1
), gap2 AS (
  SELECT * REPLACE (target - sum(copies * size) OVER (PARTITION BY source_rank) AS gap) FROM two
), open2 AS (
  SELECT * REPLACE (open AND copies = whole AND size <= gap AS fits) FROM gap2
), three AS (
  SELECT * REPLACE (copies + CASE WHEN fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source_rank ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap THEN 1 ELSE 0 END AS copies) FROM open2
), gap3 AS (
  SELECT * REPLACE (target - sum(copies * size) OVER (PARTITION BY source_rank) AS gap) FROM three
), able AS (
  SELECT *, open AND copies = whole AND abs(gap - size) < gap AS able FROM gap3
), last AS (
  SELECT *, copies + CASE WHEN able AND row_number() OVER (PARTITION BY source_rank, able ORDER BY abs(gap - size), v, doc_id, size) = 1 THEN 1 ELSE 0 END AS n FROM able
)
SELECT doc_id, source, size, source_size, target, CAST(n AS BIGINT) AS copies, CAST(n * size AS BIGINT) AS taken FROM last
"""
