"""Tag state as a stream: the fold of tag, untag, undo and redo events, kept per (codebook, row, coder).

The state of a key is a base (the last event of each category that can't be undone any more) and the
events since. An undo or redo event names a batch by its ``batch`` and comes with the rows of that batch,
as bulk edits do; it takes the batch's events out of the fold, or back in. An event-time timer moves
events that are older than the horizon into the base, so state does not grow with the log. Of equal or
late events the larger ``seq`` decides, so the order of arrival does not matter; an undo that comes after
its batch was moved has no effect.

Each change puts out the key's standing tags with a version; a key without tags puts out one row with
a null category. ``latest`` reads the state off these rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("codebook_id", "_row_idx", "coder")
CHANGES = "codebook_id string, _row_idx long, coder string, cat_id string, seq long, version long"
CHANGE = Row(*(c.split()[0] for c in CHANGES.split(", ")))
#: Of a key the number of its last change, the time of its timer (null: none), and its base and recent events as JSON.
STATE = "version long, due long, base string, recent string"

Event = tuple[int, int, str, str, str | None, int]
Base = dict[str, tuple[int, str, str | None]]


def settled(base: Base, events: Iterable[Event]) -> Base:
    """The last event of each category, of the base and of the events that are not undone."""
    undone: set[int] = set()
    for _, batch, action, *_ in sorted(events, key=lambda e: e[0]):
        if action == "undo":
            undone.add(batch)
        elif action == "redo":
            undone.discard(batch)
    out = dict(base)
    for seq, batch, action, cat, group, _ in events:
        if action in ("tag", "untag") and batch not in undone and (cat not in out or out[cat][0] < seq):
            out[cat] = (seq, action, group)
    return out


def standing(last: Base) -> list[tuple[str, int]]:
    """(cat_id, seq) of the tags that hold: of an exclusion group the latest."""
    best: dict[tuple[bool, str], tuple[int, str]] = {}
    for cat, (seq, action, group) in last.items():
        if action == "tag":
            rival = (group is None, cat if group is None else group)
            best[rival] = max(best.get(rival, (seq, cat)), (seq, cat))
    return sorted((cat, seq) for seq, cat in best.values())


class TagFold(StatefulProcessor):
    """The state of a key is one value, read once and written once a call, and it has one timer at a time."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _read(self) -> tuple[int, int | None, Base, list[Event]]:
        held = self.state.get()
        if held is None:
            return 0, None, {}, []
        version, due, base, recent = held
        return version, due, {c: tuple(v) for c, v in json.loads(base).items()}, [tuple(e) for e in json.loads(recent)]

    def _write(self, version: int, due: int | None, base: Base, recent: list[Event]) -> None:
        self.state.update((version, due, json.dumps(base), json.dumps(recent)))

    def _due(self, events: list[Event]) -> int:
        """Sets the timer at which the last of the events can be undone no more."""
        due = max(e[5] for e in events) + self.horizon
        self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = {(r.seq, r.batch, r.action, r.cat_id, r.grp, r.at) for r in rows}
        version, due, base, recent = self._read()
        events = sorted(new.union(recent), key=lambda e: e[:4])
        due = self._due(list(new)) if due is None else due
        self._write(version + 1, due, base, events)
        for cat, seq in standing(settled(base, events)) or [(None, None)]:
            yield CHANGE(*key, cat, seq, version + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """What is too old to be undone becomes the base; the tags that stand are the same after it."""
        edge = expiredTimerInfo.getExpiryTimeInMs() - self.horizon
        version, _, base, events = self._read()
        late = {e[1] for e in events if e[5] > edge}  # a batch goes as a whole
        rest = [e for e in events if e[1] in late]
        base = settled(base, [e for e in events if e[1] not in late])
        self._write(version, self._due(rest) if rest else None, base, rest)
        yield from ()

    def close(self) -> None:
        pass


def tag_changes(stream: DataFrame, horizon: str = "7 days", time: str = "ts", group: str = "group") -> DataFrame:
    """A stream of standing tags per changed key, from a stream of log events with an event time."""
    length = int(pd.Timedelta(horizon).total_seconds() * 1000)
    at = F.unix_millis(F.col(time).cast("timestamp")).alias("at")
    slim = stream.withWatermark(time, horizon).select(*KEY, "seq", "batch", "action", "cat_id", F.col(group).alias("grp"), at, time)
    return slim.groupBy(*KEY).transformWithState(TagFold(length), CHANGES, "Append", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The tags that stand after all changes: codebook_id, _row_idx, coder, cat_id, seq."""
    rank = F.rank().over(Window.partitionBy(*KEY).orderBy(F.desc("version")))
    return changes.withColumn("_r", rank).where("_r = 1 AND cat_id IS NOT NULL").select(*KEY, "cat_id", "seq")
