"""Reproducible samples, chunks and set algebra on slices.

Random choice is a rank by MD5 of seed and row id, so it does not depend on partitions, is the same
on every run, and SQL can repeat it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "__missing__"


def lot(seed: int, key: str = "_row_idx") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def random_sample(df: DataFrame, n: int, seed: int = 42, key: str = "_row_idx") -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer: a top-n, never a full sort."""
    return df.orderBy(lot(seed, key), key).limit(max(0, n))


def quotas(df: DataFrame, n: int, by: str) -> DataFrame:
    """(stratum, size, quota): shares of ``n`` by largest remainder, never over a stratum's size."""
    counts = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit(MISSING)).alias("stratum")).agg(F.count("*").alias("size"))
    whole = Window.partitionBy()
    total = F.sum("size").over(whole)
    raw = F.least(F.lit(n), total) * F.col("size") / total
    based = counts.withColumn("total", total).withColumn("base", F.floor(raw)).withColumn("rest", raw - F.floor(raw))
    short = F.least(F.lit(n), F.col("total")) - F.sum("base").over(whole)
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), "stratum"))
    return based.select("stratum", "size", (F.col("base") + (rank <= short).cast("long")).alias("quota"))


def stratified_sample(df: DataFrame, n: int, by: str, seed: int = 42, key: str = "_row_idx") -> DataFrame:
    """Proportional to the strata of ``by``, nulls being one; ``n`` rows in all."""
    marked = df.withColumn("stratum", F.coalesce(F.col(by).cast("string"), F.lit(MISSING)))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(lot(seed, key), key))
    # A first cut by lot leaves some four times the rows wanted of a stratum, so a hot one is not ranked whole.
    part = F.conv(F.substring(lot(seed, key), 1, 13), 16, 10).cast("double") / float(1 << 52)
    met = marked.join(F.broadcast(quotas(df, n, by)), "stratum") if by_few(df, by) else marked.join(quotas(df, n, by), "stratum")
    near = met.where(part * F.col("size") <= 4 * F.col("quota") + 60)
    return near.withColumn("rank", rank).where("rank <= quota").select(*df.columns)


def by_few(df: DataFrame, by: str, most: int = 50_000) -> bool:
    """Whether a column has at most ``most`` values, so that a table of one row per value may be broadcast."""
    return df.agg(F.approx_count_distinct(F.col(by).cast("string"))).first()[0] <= most // 2


def scope_sample(df: DataFrame, n: int, seed: int = 42, key: str = "_row_idx") -> DataFrame:
    """``n`` rows by lot, given back in their own order."""
    return random_sample(df, n, seed, key).orderBy(key)


def top_n(df: DataFrame, n: int, by: str, ascending: bool = False, key: str = "_row_idx") -> DataFrame:
    c = F.col(by)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), key).limit(n)


def numbered(df: DataFrame, bucket: Column, *order: Column | str) -> DataFrame:
    """``_n``: 0-based places in a global order; ``bucket`` must not fall along that order.

    A global window would sort everything in one task. Here each bucket is numbered by itself, and
    the buckets' sizes, one small row each, are added up. Buckets are a function of the row, so the
    numbers do not depend on how rows are dealt out.
    """
    marked = df.withColumn("_b", bucket)
    sizes = marked.groupBy("_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return marked.withColumn("_i", local).join(sizes.select("_b", before.alias("_o")), "_b").withColumn("_n", F.col("_o") + F.col("_i") - 1).drop("_b", "_i", "_o")


def by_index(key: str = "_row_idx") -> Column:
    return F.floor(F.col(key) / 65_536)


def systematic_sample(df: DataFrame, step: int, key: str = "_row_idx") -> DataFrame:
    return numbered(df, by_index(key), key).where(F.col("_n") % max(1, step) == 0).select(*df.columns)


def equal_chunks(df: DataFrame, k: int, seed: int = 42, overlap_pct: float = 0.0, key: str = "_row_idx") -> DataFrame:
    """Rows with their ``chunk`` (0-based); the first ``overlap_pct`` percent by lot are in every one."""
    if not 2 <= k <= 20:
        raise ValueError("between 2 and 20 chunks are possible")
    n = df.count()
    common = round(n * overlap_pct / 100)
    size, extra = divmod(n - common, k)
    placed = numbered(df.withColumn("_lot", lot(seed, key)), F.substring("_lot", 1, 3), "_lot", key)
    at = F.col("_n") - common
    edge = extra * (size + 1)
    own = F.when(at < edge, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - edge) / max(1, size)))
    chunk = F.when(at < 0, F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).otherwise(F.array(own.cast("long")))
    return placed.withColumn("chunk", F.explode(chunk)).select(*df.columns, "chunk")


def distinct_texts(df: DataFrame, key: str = "_row_idx") -> DataFrame:
    """The first row of every text, without regard to case and outer space; blank texts are one."""
    same = F.lower(F.trim(F.coalesce(F.col("text"), F.lit(""))))
    first = df.groupBy(same.alias("_t")).agg(F.min(key).alias("_k")).select("_k")
    return df.join(first, F.col(key) == F.col("_k"), "left_semi")


@dataclass(frozen=True)
class SampleSpec:
    method: str = "random"
    n: int = 200
    seed: int = 42
    by: str | None = None
    ascending: bool = False
    step: int = 10
    dedupe: bool = False
    query: str = ""

    @classmethod
    def from_dict(cls, raw: dict) -> SampleSpec:
        """Blank and zero numbers take their defaults."""
        known = {k: raw[k] for k in cls.__dataclass_fields__ if raw.get(k)}
        for k in ("n", "seed", "step"):
            if k in known:
                known[k] = int(known[k])
        return cls(**known)

    def describe(self) -> str:
        what = {"random": f"{self.n} random rows, seed {self.seed}", "stratified": f"{self.n} rows in proportion to {self.by}, seed {self.seed}",
                "top_n": f"{'lowest' if self.ascending else 'highest'} {self.n} by {self.by}", "systematic": f"every {self.step}th row"}
        return what.get(self.method, self.method) + (f" of {self.query}" if self.query else "") + (", texts once" if self.dedupe else "")


def run(df: DataFrame, spec: SampleSpec, key: str = "_row_idx") -> DataFrame:
    from tesserae.plans.boolean import matching

    rows = matching(df, spec.query)
    rows = distinct_texts(rows, key) if spec.dedupe else rows
    if spec.method == "random":
        return random_sample(rows, spec.n, spec.seed, key)
    if spec.method == "stratified" and spec.by:
        return stratified_sample(rows, spec.n, spec.by, spec.seed, key)
    if spec.method == "top_n" and spec.by:
        return top_n(rows, spec.n, spec.by, spec.ascending, key)
    if spec.method == "systematic":
        return systematic_sample(rows, spec.step, key)
    raise ValueError(f"no sample method {spec.method!r} with by={spec.by!r}")


def slice_counts(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """both, a_only, b_only and either, in one pass."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.agg(n(a & b).alias("both"), n(a & ~b).alias("a_only"), n(b & ~a).alias("b_only"), n(a | b).alias("either"))


def from_indices(df: DataFrame, indices: DataFrame, key: str = "_row_idx") -> DataFrame:
    return df.join(indices.select(key).distinct(), key, "left_semi")


def unique_to(df: DataFrame, gone: DataFrame, others: DataFrame, key: str = "_row_idx") -> DataFrame:
    """Rows of a slice to be deleted that no other frozen slice holds."""
    return df.join(gone.select(key).distinct(), key, "left_semi").join(others.select(key).distinct(), key, "left_anti")
