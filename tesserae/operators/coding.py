"""Tags as an event log: coding, exclusion groups, undo, bulk edits, categories, memos and spans.

The log has one row per action: seq, action (tag or untag), _row_idx, cat_id, coder, codebook_id,
group (exclusion group or null), source, and optional note, confidence, reason, model. The state is a
fold of the log, so undo is leaving out events and nothing is ever rewritten in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("codebook_id", "_row_idx", "coder", "cat_id")


def current(events: DataFrame) -> DataFrame:
    """The tags that hold: the last event of each tag decides, and a later tag evicts its group's others."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
    standing = events.withColumn("_r", F.row_number().over(last)).where("_r = 1 AND action = 'tag'").drop("_r")
    rival = Window.partitionBy("codebook_id", "_row_idx", "coder", F.coalesce(F.concat(F.lit("g:"), "group"), F.concat(F.lit("c:"), "cat_id"))).orderBy(F.desc("seq"))
    return standing.withColumn("_r", F.row_number().over(rival)).where("_r = 1").drop("_r", "action")


def undone(events: DataFrame, steps: int = 1) -> DataFrame:
    """The log without its last ``steps`` batches (a bulk edit shares one ``batch``)."""
    cut = events.select("batch").distinct().orderBy(F.desc("batch")).limit(min(50, max(0, steps)))
    return events.join(F.broadcast(cut), "batch", "left_anti")  # 50 rows at most


def redone(events: DataFrame, undo_steps: int, redo_steps: int = 1) -> DataFrame:
    """The log after ``undo_steps`` undone batches of which the first ``redo_steps`` were done again.

    As the log is never rewritten, redo is leaving out fewer batches; a batch that is appended later
    ends the chance to redo, since the steps then count from it.
    """
    return undone(events, max(0, min(50, undo_steps) - max(0, redo_steps)))


def scope(df: DataFrame, indices: DataFrame | None = None, slice_rows: DataFrame | None = None, query: str | None = None) -> DataFrame:
    """The rows a bulk edit is about: by indices, else by a slice, else by a query; a dry run counts them."""
    from tesserae.plans.boolean import matching

    chosen = indices if indices is not None else slice_rows
    return df.join(chosen.select("_row_idx").distinct(), "_row_idx", "left_semi") if chosen is not None else matching(df, query)


def bulk(rows: DataFrame, cat_id: str, coder: str, codebook_id: str, seq: int, group: str | None = None, action: str = "tag") -> DataFrame:
    """Events for all rows of a slice; they share a batch, so one undo takes them back."""
    return rows.select(
        F.lit(seq).cast("long").alias("seq"), F.lit(seq).cast("long").alias("batch"), F.lit(action).alias("action"), F.col("_row_idx").cast("long").alias("_row_idx"),
        F.lit(cat_id).alias("cat_id"), F.lit(coder).alias("coder"), F.lit(codebook_id).alias("codebook_id"), F.lit(group).cast("string").alias("group"), F.lit("bulk").alias("source"),
    )


def exclusive(assigned: DataFrame, groups: DataFrame, first_wins: bool = True) -> DataFrame:
    """(row, cat_id, place) without rivals within an exclusion group.

    Classifier output keeps the first of a group, guardrails keep the last.
    """
    met = assigned.join(groups.select("cat_id", F.col("exclusion_group").alias("_g")), "cat_id", "left")
    order = F.col("place").asc() if first_wins else F.col("place").desc()
    rank = F.row_number().over(Window.partitionBy("_row_idx", F.coalesce(F.concat(F.lit("g:"), "_g"), F.concat(F.lit("c:"), "cat_id"))).orderBy(order))
    return met.withColumn("_r", rank).where("_r = 1").drop("_r", "_g").select(*assigned.columns)


def rename_category(tags: DataFrame, old: str, new: str) -> DataFrame:
    return tags.withColumn("cat_id", F.when(F.col("cat_id") == old, new).otherwise(F.col("cat_id")))


def merge_categories(tags: DataFrame, sources: list[str], target: str) -> DataFrame:
    """Tags of ``sources`` become ``target``, once per (codebook, row, coder)."""
    moved = tags.withColumn("cat_id", F.when(F.col("cat_id").isin(sources), target).otherwise(F.col("cat_id")))
    return moved.dropDuplicates(["codebook_id", "_row_idx", "coder", "cat_id"])


def merge_scores(scores: Column, sources: list[str], target: str) -> Column:
    """A map of scores with those of ``sources`` added to ``target``, at most 1."""
    of = lambda k: F.coalesce(F.get(F.map_values(F.map_filter(scores, lambda n, _: n == k)), F.lit(0)), F.lit(0.0))
    total = of(target)
    for s in sources:
        total = total + of(s)
    rest = F.map_filter(scores, lambda n, _: ~n.isin([*sources, target]))
    return F.map_concat(rest, F.create_map(F.lit(target), F.least(F.lit(1.0), total)))


def delete_categories(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, [c for c in ("codebook_id", "cat_id") if c in gone.columns], "left_anti")


def progress(tags: DataFrame) -> dict[str, DataFrame]:
    """Rows tagged, entries by category, and distinct rows by coder."""
    return {
        "rows": tags.agg(F.countDistinct("_row_idx").alias("rows_tagged")),
        "by_category": tags.groupBy("cat_id").agg(F.count("*").alias("n")),
        "by_coder": tags.groupBy("coder").agg(F.countDistinct("_row_idx").alias("n")),
    }


def attach_tags(rows: DataFrame, tags: DataFrame, categories: DataFrame) -> DataFrame:
    """``rows`` with a ``tag`` column: the distinct category titles in order, joined by `` + ``."""
    titled = tags.join(categories.select("cat_id", "title"), "cat_id", "left")
    joined = titled.groupBy("_row_idx").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("title", "cat_id"))), " + ").alias("tag"))
    return rows.join(joined, "_row_idx", "left").withColumn("tag", F.coalesce("tag", F.lit("")))


def memos(log: DataFrame, coder: str | None = None, codebook_id: str | None = None, contains: str | None = None) -> DataFrame:
    """Memos that stand (last edit, not deleted), newest first."""
    last = log.withColumn("_r", F.row_number().over(Window.partitionBy("memo_id").orderBy(F.desc("seq")))).where("_r = 1 AND action <> 'delete'").drop("_r")
    for name, value in (("coder", coder), ("codebook_id", codebook_id)):
        last = last.where(F.col(name) == value) if value else last
    last = last.where(F.lower("text").contains(contains.lower())) if contains else last
    return last.orderBy(F.desc("ts"), "memo_id")


def memo_counts(standing: DataFrame) -> DataFrame:
    return standing.agg(F.count("*").alias("memos"), F.countDistinct("_row_idx").alias("rows"), F.countDistinct("coder").alias("coders"))


def memos_by_coder(standing: DataFrame) -> DataFrame:
    return standing.groupBy("coder").agg(F.count("*").alias("memos"))


def span_texts(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Annotated spans (start inclusive, end exclusive) with their text."""
    met = spans.where("end > start").join(rows.select("_row_idx", "text"), "_row_idx")
    return met.withColumn("quote", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")


def remove_span(spans: DataFrame, row: int, start: int, end: int, cat_id: str) -> DataFrame:
    """Without the first span that fits; a span that starts at 0 can be removed as any other."""
    fits = (F.col("_row_idx") == row) & (F.col("start") == start) & (F.col("end") == end) & (F.col("cat_id") == cat_id)
    first = spans.where(fits).agg(F.min("seq").alias("seq"))
    return spans.join(F.broadcast(first), "seq", "left_anti")  # one row


def codebook_diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = ("title", "description", "exclusion_group", "shortcut_key", "color")) -> DataFrame:
    """(cat_id, change, fields): added, removed, or changed with the names of the fields."""
    a, b = old.select("cat_id", F.struct(*fields).alias("a")), new.select("cat_id", F.struct(*fields).alias("b"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differ) > 0, "changed")
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), differ).otherwise(F.array().cast("array<string>"))
    return a.join(b, "cat_id", "full").select("cat_id", change.alias("change"), F.array_join(both, ",").alias("fields")).where("change IS NOT NULL")


# --- topics ---------------------------------------------------------------------------------------


def topic_counts(assigned: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows of every topic, those without any included."""
    counts = assigned.groupBy("topic_id").agg(F.count("*").alias("n"))
    return topics.select("topic_id").join(counts, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).alias("n"))


def merge_topics(assigned: DataFrame, sources: list[str], target: str) -> DataFrame:
    return assigned.withColumn("topic_id", F.when(F.col("topic_id").isin(sources), target).otherwise(F.col("topic_id")))


def topic_rows(assigned: DataFrame, rows: DataFrame, topic_id: str, k: int = 20) -> DataFrame:
    """The first ``k`` rows of a topic by row index, with their texts."""
    mine = assigned.where(F.col("topic_id") == topic_id).select("_row_idx").orderBy("_row_idx").limit(k)
    return rows.select("_row_idx", "text").join(F.broadcast(mine), "_row_idx")  # k rows
