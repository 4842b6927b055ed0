"""Quality rules: base counts, then robust multivariate outliers, with DataFrame operations only.

The base counts are taken in one pass over the texts and written as a slim table. On its rows that
pass the base rules, the minimum covariance determinant is sought per language and source: the mean
and covariance of the ``share`` of rows whose covariance has the least determinant. The search has
``STARTS``: coordinatewise medians and quartiles, all rows, and small subsets chosen by hash. From each
one, concentration steps keep the share of rows with the least Mahalanobis distance and estimate anew;
after two steps the best ``BEST`` go on until the determinant stands still, and the least one wins.

A step is one aggregate per group and bin of the logarithm of the distance, with a map-side part. The
bin in which the share is reached counts by the fraction that is wanted, so exactly the share is kept,
no group is ever sorted or gathered, results do not depend on the order of rows, and a hot group costs
a task no more than any other. The estimate is made consistent for normal data; rows beyond ``cutoff``
are rejected, which is far out, since statistics of texts have longer tails than normal ones.

The transformed statistics are the logs of the word count, of the mean word length and of the share of
characters that are neither letters nor digits; the last two are shrunk toward ``PRIOR_LENGTH`` and
``PRIOR_MARKS`` by ``PRIOR_WORDS`` words and ``PRIOR_CHARS`` characters, as short texts vary by chance.
Where the covariance is degenerate (nearly all rows of a group share a value, or one statistic follows
from others) a conditional standard deviation under ``FLOOR`` is raised to it, and the rows judged so are
marked ``degenerate``.

Sources with fewer than ``least`` passing rows in a language are judged by an estimate from all passing
rows of the language, and languages with fewer by one from all passing rows. If even those are fewer,
standard deviations are at least those of ``FEW_ROWS``. A null language or source is a group of its
own. Null texts have no words and fail the base rules. Repeated rows count as often as they occur.
Extra columns are ignored.
"""

from __future__ import annotations

from math import erf, exp, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SYMBOLS = "#*$%&|<>"
PRIOR_LENGTH, PRIOR_WORDS = 5.0, 20.0
PRIOR_MARKS, PRIOR_CHARS = 0.03, 100.0
SHARE, LEAST = 0.75, 100
#: Rows of a start chosen by hash, seeds of such starts, starts that go on, and steps between two looks at the determinant.
SUBSET, SEEDS, BEST, STEPS = 12, (1, 2), 2, 3
STARTS = 2 + len(SEEDS)
#: Relative change of the determinant in a step that counts as standing still, and looks at it before the search gives up.
STILL, LOOKS = 1e-3, 20
#: Squared distance beyond which a row is rejected: nearly eight standard deviations in some direction.
CUTOFF = 60.0
#: Least conditional standard deviation of each statistic, and least ones where fewer than ``LEAST`` rows are known.
FLOOR, FEW_ROWS = (0.01, 0.01, 0.01), (1.0, 0.35, 1.0)
#: Bins of the distance histogram in each unit of its logarithm.
BINS = 32
NAMES = ("x1", "x2", "x3")


def counted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and marks."""
    text = F.coalesce(docs["text"], F.lit(""))
    has = lambda c: docs[c].cast("string") if c in docs.columns else F.lit(None).cast("string")
    spaces = " \t\n\x0b\x0c\r"
    base = docs.select(
        docs["doc_id"].alias("doc_id"),
        has("lang").alias("lang"),
        has("source").alias("source"),
        F.length(F.translate(text, spaces, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long").alias("marks"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, spaces, "")) > 0).alias("lines"),
        shared.words_of(text).alias("words"),
    )
    # A window of five words as a 64-bit hash; equal hashes stand for equal windows of one text.
    five = F.when(
        F.size("words") >= 5,
        F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(5)))),
    ).otherwise(F.array().cast("array<bigint>"))
    seen = base.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "marks",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        five.alias("five"),
    )
    # Only texts with a repeated window are sorted: neighbours with one hash are its occurrences.
    repeats = F.size("five") > F.size(F.array_distinct("five"))
    pairs = F.when(repeats, F.sort_array(F.transform("five", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ranked = seen.withColumn("by_hash", pairs).drop("five")
    here = lambda i: F.get("by_hash", i)["h"]
    often = F.filter("by_hash", lambda x, i: F.coalesce(((i > 0) & (here(i - 1) == x["h"])) | (here(i + 1) == x["h"]), F.lit(False)))
    starts = ranked.withColumn("starts", F.when(F.col("by_hash").isNotNull(), F.sort_array(F.transform(often, lambda x: x["i"])))).drop("by_hash")
    zero = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("starts", zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])
    return starts.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "marks", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics() -> list[Column]:
    words, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return [
        F.log(words).alias("x1"),
        F.log((chars + PRIOR_LENGTH * PRIOR_WORDS) / (words + PRIOR_WORDS)).alias("x2"),
        F.log((F.col("marks") + PRIOR_MARKS * PRIOR_CHARS) / (chars + PRIOR_CHARS)).alias("x3"),
    ]


def chi2_cdf(x: float, p: int) -> float:
    """The chi-squared distribution for odd degrees of freedom ``p``."""
    out, term = erf(sqrt(x / 2)), sqrt(2 * x / pi) * exp(-x / 2)
    for k in range(1, p, 2):
        out -= term
        term *= x / (k + 2)
    return out


def consistency(share: float, p: int = 3) -> float:
    """What the covariance of the nearest ``share`` of normal rows must be multiplied by."""
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < share else (low, mid)
    return share / chi2_cdf(low, p + 2)


CELLS = [(i, j) for i in range(1, 4) for j in range(i, 4)]
ESTIMATE = [f"m{i}" for i in range(1, 4)] + [f"c{i}{j}" for i, j in CELLS]


def factor(floor: tuple[float, ...] = FLOOR) -> tuple[dict[tuple[int, int], Column], list[Column]]:
    """The Cholesky factor of c11.. with pivots of at least ``floor``, and the pivots as they were."""
    low: dict[tuple[int, int], Column] = {}
    pivots: list[Column] = []
    for i in range(1, len(floor) + 1):
        for j in range(1, i + 1):
            rest = F.col(f"c{j}{i}")
            for k in range(1, j):
                rest = rest - low[i, k] * low[j, k]
            if i == j:
                pivots.append(rest)
                rest = F.sqrt(F.greatest(rest, F.lit(floor[i - 1] ** 2)))
            low[i, j] = rest if i == j else rest / low[j, j]
    return low, pivots


def factored(estimates: DataFrame, floor: Column | None = None) -> DataFrame:
    """``estimates`` with the factor l11.., the determinant ``det`` and whether it is ``degenerate``."""
    low, pivots = factor()
    if floor is not None:  # estimates from few rows: the diagonal is raised, then factored again
        raised = [F.when(floor, F.greatest(F.col(f"c{i}{i}"), F.lit(f * f))).otherwise(F.col(f"c{i}{i}")).alias(f"c{i}{i}") for i, f in enumerate(FEW_ROWS, 1)]
        others = [F.when(floor, F.lit(0.0)).otherwise(F.col(f"c{i}{j}")).alias(f"c{i}{j}") for i, j in CELLS if i != j]
        estimates = estimates.withColumn("few", floor).select(*[c for c in estimates.columns if not c.startswith("c")], "few", *raised, *others)
    det = F.lit(1.0)
    for i in range(1, 4):
        det = det * low[i, i] * low[i, i]
    flat = F.lit(False)
    for p, f in zip(pivots, FLOOR, strict=True):
        flat = flat | (p < f * f)
    return estimates.withColumns({**{f"l{i}{j}": c for (i, j), c in low.items()}, "det": det, "degenerate": flat | F.col("few") if floor is not None else flat})


def distance() -> Column:
    """Squared Mahalanobis distance of x1.. from m1.. by the factor l11.."""
    z: list[Column] = []
    for i in range(1, 4):
        value = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(1, i):
            value = value - F.col(f"l{i}{k}") * z[k - 1]
        z.append(value / F.col(f"l{i}{i}"))
    return z[0] * z[0] + z[1] * z[1] + z[2] * z[2]


def starts(rows: DataFrame) -> DataFrame:
    """Estimates (g, s, m1.., c11..) that the search begins from."""
    quarters = rows.groupBy("g").agg(*[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(x) for x in NAMES])
    middle = [F.col(x)[1].alias(f"m{i}") for i, x in enumerate(NAMES, 1)]
    spread = [(F.pow((F.col(f"x{i}")[2] - F.col(f"x{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in CELLS]
    made = quarters.select("g", F.lit(0).alias("s"), *middle, *spread)
    moments = [F.avg(x).alias(f"m{i}") for i, x in enumerate(NAMES, 1)] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in CELLS]
    made = made.unionByName(rows.groupBy("g").agg(*moments).withColumn("s", F.lit(1)))
    for s, seed in enumerate(SEEDS, 2):
        order = Window.partitionBy("g").orderBy(F.xxhash64(*NAMES, F.lit(seed)), *NAMES)
        some = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SUBSET)
        made = made.unionByName(some.groupBy("g").agg(*moments).withColumn("s", F.lit(s)))
    return made.select("g", "s", *ESTIMATE)


class Step:
    """One concentration step; its expressions are the same in every step and are built once."""

    def __init__(self, share: float):
        low, _ = factor()
        same = [F.col(c) for c in ("m1", "m2", "m3", "old")]  # of one estimate throughout
        det = F.lit(1.0)
        for i in range(1, 4):
            det = det * low[i, i] * low[i, i]
        self.here = [F.col("g"), F.col("s"), *same[:3], *[c.alias(f"l{i}{j}") for (i, j), c in low.items()], det.alias("old")]
        off = [(F.col(x) - F.col(f"m{i}")).alias(f"o{i}") for i, x in enumerate(NAMES, 1)]
        self.near = [F.col("g"), F.col("s"), F.floor(F.log(distance() + 1e-9) * BINS).alias("bin"), *same, *off]
        sums = [F.count("*").alias("n")] + [F.sum(f"o{i}").alias(f"a{i}") for i in range(1, 4)]
        sums += [F.sum(F.col(f"o{i}") * F.col(f"o{j}")).alias(f"b{i}{j}") for i, j in CELLS]
        first = [F.first(c).alias(n) for c, n in zip(same, ("m1", "m2", "m3", "old"), strict=True)]
        self.sums = sums + first
        upto = Window.partitionBy("g", "s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("n").over(upto), F.lit(0))
        wanted = F.lit(share) * F.sum("n").over(Window.partitionBy("g", "s"))
        self.part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wanted - below) / F.col("n")))
        total = F.sum(F.col("part") * F.col("n"))
        cells = [f"{i}{j}" for i, j in CELLS]
        self.kept = [(F.sum(F.col("part") * F.col(c)) / total).alias(c) for c in ["a1", "a2", "a3", *(f"b{c}" for c in cells)]] + first
        mean = [(F.col(f"m{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(1, 4)]
        self.after = [F.col("g"), F.col("s"), *mean, *[(F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")).alias(f"c{i}{j}") for i, j in CELLS], F.col("old")]

    def __call__(self, rows: DataFrame, now: DataFrame, count: int) -> DataFrame:
        """From the estimates ``now`` (g, s, m1.., c11..), of which there are ``count`` at most; ``old`` is their determinant."""
        near = rows.join(shared.small(now.select(*self.here), count), "g").select(*self.near)
        bins = near.groupBy("g", "s", "bin").agg(*self.sums)
        return bins.withColumn("part", self.part).where("part > 0").groupBy("g", "s").agg(*self.kept).select(*self.after)


def estimates(rows: DataFrame, share: float = SHARE, groups: int = shared.FEW + 1) -> DataFrame:
    """Per group ``g`` of rows (g, x1, x2, x3): m1.. and c11.. of the least determinant found, of ``groups`` at most."""
    spark, step = rows.sparkSession, Step(share)

    def go(now: DataFrame, steps: int, count: int) -> DataFrame:
        for _ in range(steps):
            now = step(rows, now, count)
        return now

    def best(now: DataFrame, most: int) -> DataFrame:
        return now.withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy("det", "s"))).where(F.col("nth") <= most).drop("nth")

    plain = ["g", "s", *ESTIMATE, "old", "det"]
    first = shared.stored(starts(rows), "mcd")
    now = shared.stored(best(factored(go(first, 2, groups * STARTS)).select(*plain), BEST), "mcd")
    shared.dropped(spark, first)
    for _ in range(LOOKS):
        after = shared.stored(factored(go(now, STEPS, groups * BEST)).select(*plain), "mcd")
        still = after.where(F.abs(F.col("det") - F.col("old")) > STILL * F.col("old")).isEmpty()
        shared.dropped(spark, now)
        now = after
        if still:
            break
    scale = consistency(share)
    return best(now, 1).select("g", *[f"m{i}" for i in range(1, 4)], *[(F.col(f"c{i}{j}") * scale).alias(f"c{i}{j}") for i, j in CELLS])


def _keys() -> tuple[Column, Column, Column]:
    """Names of a row's own group, of the pool of its language and of that of all rows."""
    lang, source = (F.coalesce(F.col(c), F.lit("\x1e")) for c in ("lang", "source"))
    return F.concat_ws("\x1f", lang, source), F.concat_ws("\x1f", lang, F.lit("\x1d"), F.lit("pool")), F.lit("\x1d")


def judge(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, the squared distance and degenerate."""
    slim = shared.stored(counted(docs), "quality")
    passed = slim.where(~base_failed())
    own, pool, every = _keys()
    sizes = passed.groupBy(pool.alias("pool"), own.alias("own")).agg(F.count("*").alias("n"))
    within = sizes.withColumn("lang_n", F.sum("n").over(Window.partitionBy("pool")))
    g = F.when(F.col("n") >= least, F.col("own")).when(F.col("lang_n") >= least, F.col("pool")).otherwise(every)
    homes = shared.stored(within.withColumn("g", g), "groups")
    groups = 2 * homes.count() + 1  # each own group, at most as many pools, and that of all rows
    # A row counts toward its own group, and toward the pools that any group is judged by.
    pooled = F.max(F.col("g") == F.col("pool")).over(Window.partitionBy("pool"))
    alone = not homes.where(F.col("g") == every).isEmpty()
    feeds = F.array(F.when(F.col("n") >= least, F.col("own")), F.when(pooled, F.col("pool")), every if alone else F.lit(None))
    homes = shared.stored(homes.select("own", "g", "n", F.array_compact(feeds).alias("feeds")), "homes")
    sized = slim.withColumn("own", own).join(shared.small(homes.drop("n"), groups), "own", "left")
    grouped = sized.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "marks",
        "g", "feeds", base_failed().alias("base_failed"),
    )
    rows = shared.stored(grouped.where(~F.col("base_failed")).select(F.explode("feeds").alias("g"), *statistics()), "vectors")
    passing = homes.agg(F.sum("n")).first()[0] or 0
    found = shared.stored(factored(estimates(rows, share, groups=groups), F.lit(passing < least)), "estimates")
    shared.dropped(docs.sparkSession, rows)
    placed = grouped.join(shared.small(found, groups), "g", "left").withColumns({n: c for n, c in zip(NAMES, statistics(), strict=True)})
    scored = placed.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"),
        "distance", F.when(~F.col("base_failed"), F.col("degenerate")).alias("degenerate"),
    )
