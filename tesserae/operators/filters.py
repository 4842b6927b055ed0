"""Composable row filters, whitelisted sorting and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.schema import CANONICAL, COUNTS

MEMBERSHIP = ("platform", "language", "country", "source_type", "source_dataset")
#: The columns that rows may be sorted by.
SORTABLE = ("_row_idx", "post_id", "platform", "source_type", "author_handle", "author_name", "text", "language", "created_at", "like_count", "share_count", "comment_count", "view_count", "country")
PREVIEW = ("_row_idx", "post_id", "platform", "source_type", "author_handle", "author_name", "text", "language", "created_at", "url", "like_count", "share_count")


@dataclass(frozen=True)
class FilterSpec:
    """All conditions hold together; a condition on a column that is absent is passed over."""

    text: str | None = None
    regex: bool = False
    case_sensitive: bool = False
    members: dict[str, list[str]] = field(default_factory=dict)
    date_from: str | None = None
    date_to: str | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: dict) -> FilterSpec:
        """Unknown counts and bounds that are no numbers are dropped."""

        def number(x: object) -> float | None:
            try:
                return float(x) if x not in (None, "") else None
            except (TypeError, ValueError):
                return None

        ranges = {}
        for name, bounds in (raw.get("ranges") or {}).items():
            pair = (number(bounds.get("min")), number(bounds.get("max")))
            if name in COUNTS and pair != (None, None):
                ranges[name] = pair
        members = {k: list(v) for k, v in (raw.get("members") or {}).items() if k in MEMBERSHIP}
        plain = {k: raw[k] for k in ("text", "regex", "case_sensitive", "date_from", "date_to") if raw.get(k)}
        return cls(members=members, ranges=ranges, **plain)


def text_condition(c: Column, wanted: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    if regex:
        try:
            re.compile(wanted)
        except re.error as bad:
            raise ValueError(f"not a regular expression: {bad}") from bad
        return c.rlike(wanted if case_sensitive else f"(?iu){wanted}")
    return c.contains(wanted) if case_sensitive else F.lower(c).contains(wanted.lower())


def member_condition(c: Column, values: list[str]) -> Column | None:
    """Lower-case membership; null never matches, and no values at all is no condition."""
    wanted = [v.strip().lower() for v in values if v and v.strip()]
    return F.coalesce(F.lower(c.cast("string")).isin(wanted), F.lit(False)) if wanted else None


def date_condition(c: Column, start: str | None, end: str | None) -> Column:
    """Both ends count; a bare date as the end means its whole day. Null dates don't match."""
    out = c.isNotNull()
    if start:
        out = out & (c >= F.lit(start).cast("timestamp"))
    if end:
        bare = re.fullmatch(r"\d{4}-\d\d-\d\d", end.strip())
        limit = F.lit(end).cast("timestamp")
        out = out & (c < limit + F.expr("INTERVAL 1 DAY") if bare else c <= limit)
    return out


def range_condition(c: Column, low: float | None, high: float | None) -> Column:
    n = c.try_cast("double")
    out = F.lit(True)
    if low is not None:
        out = out & (n >= low)
    if high is not None:
        out = out & (n <= high)
    return F.coalesce(out, F.lit(False))


def apply(df: DataFrame, spec: FilterSpec) -> DataFrame:
    kinds, wanted = dict(df.dtypes), []
    if spec.text and "text" in kinds:
        wanted.append(text_condition(F.col("text"), spec.text, spec.regex, spec.case_sensitive))
    for name, values in spec.members.items():
        if name in kinds and (c := member_condition(F.col(name), values)) is not None:
            wanted.append(c)
    if (spec.date_from or spec.date_to) and "created_at" in kinds:
        fits = kinds["created_at"].startswith("timestamp")
        wanted.append(date_condition(F.col("created_at"), spec.date_from, spec.date_to) if fits else F.lit(False))
    for name, (low, high) in spec.ranges.items():
        if name in kinds:
            wanted.append(range_condition(F.col(name), low, high))
        elif low is not None:
            wanted.append(F.lit(False))
    return df.where(reduce(Column.__and__, wanted)) if wanted else df


def ordered(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Nulls last either way, ties by ``_row_idx``; other columns than SORTABLE leave the order alone."""
    if by not in SORTABLE or by not in df.columns:
        return df
    c = F.col(by).try_cast("double") if by in COUNTS else F.col(by)
    ties = [F.col("_row_idx")] if "_row_idx" in df.columns and by != "_row_idx" else []
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)


def page(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered DataFrame; sizes are held between 1 and 500."""
    size = min(500, max(1, int(size)))
    return df.offset((max(1, int(number)) - 1) * size).limit(size)


def row(df: DataFrame, index: int) -> DataFrame:
    return df.where(F.col("_row_idx") == index)


def projected(df: DataFrame, export: bool = False) -> DataFrame:
    names = (*PREVIEW, *(n for n in ("comment_count", "view_count", "country", "region", "hashtags", "source_dataset") if export))
    return df.select(*[n for n in names if n in df.columns])


def canonical_only(df: DataFrame) -> DataFrame:
    return df.select(*[n for n in (*CANONICAL, "source_dataset", "source_id", "_row_idx") if n in df.columns])
