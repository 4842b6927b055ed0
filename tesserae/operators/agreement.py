"""Agreement between coders, conflicts, uncertainty and sample diagnostics.

A row counts for a coder if they gave it any tag of the codebook ("touched"), whatever the category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def touched(tags: DataFrame) -> DataFrame:
    return tags.select("_row_idx", "coder").distinct()


def kappa_of(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa of two by two counts: null without rows, 1 where chance explains all."""
    n = (n11 + n10 + n01 + n00).cast("double")
    po = (n11 + n00) / n
    pe = ((n11 + n10) / n) * ((n11 + n01) / n) + ((n01 + n00) / n) * ((n10 + n00) / n)
    return F.when(n == 0, F.lit(None)).when(pe == 1, F.lit(1.0)).otherwise(F.try_divide(po - pe, 1 - pe))


def kappa(tags: DataFrame, categories: DataFrame, a: str, b: str) -> DataFrame:
    """(cat_id, n, kappa, weight) over rows that both coders touched; weight is rows with a yes, 1 at least."""
    said = lambda coder: F.collect_set(F.when(F.col("coder") == coder, F.col("cat_id")))
    there = lambda coder: F.max(F.col("coder") == coder)
    both = tags.where(F.col("coder").isin(a, b)).groupBy("_row_idx").agg(said(a).alias("x"), said(b).alias("y"), there(a).alias("ta"), there(b).alias("tb")).where("ta AND tb")
    # Only a yes is a row; a category's rows without one follow from the count of rows.
    cells = both.select("x", "y", F.explode(F.array_union("x", "y")).alias("cat_id"))
    yes = lambda side: F.array_contains(side, F.col("cat_id"))
    counts = cells.groupBy("cat_id").agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("n11", yes("x") & yes("y")), ("n10", yes("x") & ~yes("y")), ("n01", ~yes("x") & yes("y")))])
    every = categories.select("cat_id").distinct().join(counts, "cat_id", "left").na.fill(0).crossJoin(F.broadcast(both.agg(F.count("*").alias("n"))))  # one row
    n = [F.col("n11"), F.col("n10"), F.col("n01"), F.col("n") - F.col("n11") - F.col("n10") - F.col("n01")]
    return every.where("n > 0").select("cat_id", "n", kappa_of(*n).alias("kappa"), F.greatest(F.lit(1), n[0] + n[1] + n[2]).alias("weight"))


def mean_kappa(by_category: DataFrame) -> DataFrame:
    known = by_category.where("kappa IS NOT NULL")
    return known.agg((F.sum(F.col("kappa") * F.col("weight")) / F.sum("weight")).alias("kappa"))


def alpha(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """(cat_id, values, alpha): Krippendorff's nominal alpha over rows of two coders or more."""
    pairs = F.collect_set(F.struct("cat_id", "coder"))
    units = tags.groupBy("_row_idx").agg(F.countDistinct("coder").alias("m"), pairs.alias("p")).where("m >= 2")
    told = units.select("_row_idx", "m", F.explode("p.cat_id").alias("cat_id")).groupBy("_row_idx", "m", "cat_id").agg(F.count("*").alias("y"))
    yes, no = F.col("y").cast("double"), (F.col("m") - F.col("y")).cast("double")
    counts = told.groupBy("cat_id").agg(F.sum(yes).alias("yes"), F.sum(2 * yes * no / (F.col("m") - 1)).alias("apart"))
    values = F.broadcast(units.agg(F.sum("m").alias("n")))  # one row; a no needs none of its own
    every = categories.select("cat_id").distinct().join(counts, "cat_id", "left").na.fill(0.0).crossJoin(values)
    sums = every.where("n IS NOT NULL").withColumn("no", F.col("n") - F.col("yes"))
    seen = F.col("apart") / F.col("n")
    due = F.try_divide(2 * F.col("yes") * F.col("no"), F.col("n") * (F.col("n") - 1).cast("double"))
    out = F.when(F.col("n") < 2, F.lit(None)).when(due == 0, F.lit(1.0)).otherwise(1 - F.try_divide(seen, due))
    return sums.select("cat_id", F.col("n").alias("values"), out.alias("alpha"))


def mean_alpha(by_category: DataFrame) -> DataFrame:
    """The plain mean of the categories whose alpha is known."""
    return by_category.agg(F.avg("alpha").alias("alpha"), F.count("alpha").alias("categories"))


def agreement(tags: DataFrame, categories: DataFrame) -> tuple[str, DataFrame | None]:
    """The statistic that fits the number of coders: kappa for two, alpha for more."""
    coders = [r.coder for r in tags.select("coder").distinct().orderBy("coder").limit(3).collect()]
    if len(coders) < 2:
        return "two coders are needed", None
    return ("kappa", kappa(tags, categories, *coders)) if len(coders) == 2 else ("alpha", alpha(tags, categories))


def coder_overlap(tags: DataFrame) -> DataFrame:
    """(a, b, shared) for each pair of coders by name, and (a, a, rows) for each one."""
    t = touched(tags)
    coders = t.groupBy("_row_idx").agg(F.array_sort(F.collect_set("coder")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return coders.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def conflicts(tags: DataFrame) -> DataFrame:
    """Rows where the coders' sets of categories are not all equal, with the sets."""
    sets = tags.groupBy("_row_idx", "coder").agg(F.array_join(F.array_sort(F.collect_set("cat_id")), "+").alias("cats"))
    rows = sets.groupBy("_row_idx").agg(F.countDistinct("cats").alias("kinds"), F.count("*").alias("coders"), F.array_join(F.array_sort(F.collect_set("cats")), " | ").alias("sets"))
    return rows.where("kinds > 1")


def uncertainty(df: DataFrame, confidence: str = "ai_confidence", told: str = "ai_category", human: str = "human_category") -> DataFrame:
    """``df`` with ``uncertainty``: low confidence, confidence near a half, and a human who disagrees."""
    c = F.col(confidence)
    point = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    return df.withColumn("uncertainty", point(c < 0.6, 0.6) + point(c.between(0.45, 0.65), 0.3) + point(F.col(human).isNotNull() & (F.col(human) != "") & (F.col(human) != F.coalesce(told, F.lit(""))), 0.5))


def most_uncertain(df: DataFrame, k: int = 20, key: str = "_row_idx", **names: str) -> DataFrame:
    return uncertainty(df, **names).orderBy(F.desc("uncertainty"), key).limit(k)


# --- diagnostics ----------------------------------------------------------------------------------


def variation_distance(corpus: DataFrame, sample: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Total variation between the shares of the top ``k`` values on each side."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        top = df.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(k)
        return top.select("v", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    met = shares(corpus, "p").join(shares(sample, "q"), "v", "full")
    return met.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))


def missing_months(corpus: DataFrame, sample: DataFrame, date: str = "created_at") -> DataFrame:
    """Months of the corpus, and how many the sample has no row of."""
    months = lambda df: df.where(F.col(date).isNotNull()).select(F.date_format(date, "yyyy-MM").alias("m")).distinct()
    met = months(corpus).join(months(sample).withColumn("there", F.lit(1)), "m", "left")
    return met.agg(F.count("*").alias("months"), F.sum(F.col("there").isNull().cast("long")).alias("missing"))


def top_decile_share(df: DataFrame, column: str) -> DataFrame:
    """The share of the total that the largest tenth of the values holds.

    Two approximate quantiles bracket the cut: values above are summed, and only those between are
    counted by value and put in order.
    """
    x = df.select(F.col(column).try_cast("double").alias("x")).where("x IS NOT NULL")
    n, total, around = x.agg(F.count("*"), F.sum("x"), F.percentile_approx("x", F.array(F.lit(0.899), F.lit(0.901)), F.lit(10_000))).first()
    if not n:
        return x.agg(F.lit(None).cast("double").alias("share"))
    k = max(1, n // 10)
    low, high = around if n > 1_000 else (float("-inf"), float("inf"))  # of few rows all are put in order
    above, over = x.where(F.col("x") > high).agg(F.count("*"), F.coalesce(F.sum("x"), F.lit(0.0))).first()
    by_value = x.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.lit(k - above) - before))
    edge = by_value.select((F.col("x") * taken).alias("part"))
    return edge.agg(F.try_divide(F.coalesce(F.sum("part"), F.lit(0.0)) + over, F.lit(float(total or 0.0))).alias("share"))


def diagnose(corpus: DataFrame, sample: DataFrame) -> list[str]:
    """Warnings about a sample; none means that it stands for the corpus."""
    out = []
    for c in ("platform", "language"):
        if c in corpus.columns and (d := variation_distance(corpus, sample, c).first()[0]) and d > 0.15:
            out.append(f"{c} differs from the corpus by {d:.2f}")
    if "created_at" in corpus.columns:
        m = missing_months(corpus, sample).first()
        if m.months and m.missing / m.months > 0.25:
            out.append(f"{m.missing} of {m.months} months are missing")
    lengths = [length_quantiles(df).first() for df in (corpus, sample)]
    if all(r.p50 is not None for r in lengths) and (lengths[1].p50 < 0.5 * lengths[0].p50 or lengths[1].p50 > 2 * lengths[0].p50):
        out.append(f"the median length is {lengths[1].p50:.0f}, that of the corpus {lengths[0].p50:.0f}")
    for c in ("like_count", "share_count", "comment_count", "view_count"):
        if c in corpus.columns:
            a, b = (top_decile_share(df, c).first()[0] for df in (corpus, sample))
            if a is not None and b is not None and abs(a - b) > 0.15:
                out.append(f"the top tenth holds {b:.2f} of {c}, in the corpus {a:.2f}")
            break
    return out


def guardrails(output: DataFrame, known: list[str]) -> DataFrame:
    """Counts of classifier output with unknown categories, confidence out of range, and low confidence."""
    c = F.col("confidence").try_cast("double")
    return output.agg(
        F.count("*").alias("rows"), F.sum((~F.col("cat_id").isin(known)).cast("long")).alias("unknown"),
        F.sum((c.isNull() | (c < 0) | (c > 1)).cast("long")).alias("out_of_range"), F.sum(F.coalesce(c < 0.4, F.lit(False)).cast("long")).alias("low"),
    )


def guardrail_warnings(counts: DataFrame, share: float = 0.2) -> list[str]:
    """Warnings from :func:`guardrails`: any unknown category or impossible confidence, and a fifth of low ones."""
    r = counts.first()
    out = [f"{n} rows have {what}" for n, what in ((r.unknown, "an unknown category"), (r.out_of_range, "a confidence out of range")) if n]
    return out + ([f"{r.low} of {r.rows} rows have low confidence"] if r.rows and (r.low or 0) >= share * r.rows else [])


def conflict_summary(tags: DataFrame) -> DataFrame:
    """How many rows are in conflict, and how many categories and coders take part."""
    rows = conflicts(tags).select("_row_idx")
    return tags.join(rows, "_row_idx", "left_semi").agg(F.countDistinct("_row_idx").alias("conflicts"), F.countDistinct("cat_id").alias("cats"), F.countDistinct("coder").alias("coders"))


def adjudications(log: DataFrame, note: int = 500) -> DataFrame:
    """The last decision on every row in an adjudication log, its note cut to ``note`` characters."""
    last = log.groupBy("_row_idx").agg(F.max_by(F.struct("cat_id", "judge", "note"), "seq").alias("d"))
    return last.select("_row_idx", "d.cat_id", "d.judge", F.substring("d.note", 1, note).alias("note"))


def length_quantiles(df: DataFrame, column: str = "text") -> DataFrame:
    n = F.length(column).cast("double")
    return df.agg(*[F.percentile(n, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])
