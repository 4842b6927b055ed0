"""An event log with a tail: small batches are appended, old ones become a snapshot of the state.

A state of the log (see ``manifest``) names the snapshot, the batches it holds, and the batches after it.
Every append is a folder of its own and one commit, so two writers lose nothing. ``compact`` folds the
snapshot and its tail into a new snapshot, stamped with the batches that it took in; batches that
are appended meanwhile stay in the tail. ``replay`` gives snapshot and tail, ``tail`` the events alone.

A fold must not care where it is cut: what it keeps of old events must decide against later events as
the events themselves would. ``last_of`` is the usual one, the last event of each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.manifest import Manifest, State

Fold = Callable[[DataFrame], DataFrame]


def last_of(*keys: str, order: str = "seq") -> Fold:
    """A fold that keeps the last event of each key; of events of the same place, which are repeats, one."""

    def fold(events: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        return events.withColumn("_r", rank).where("_r = 1").drop("_r")

    return fold


class EventLog:
    """A log under ``root`` with a fold."""

    def __init__(self, spark: SparkSession, root: str, fold: Fold):
        self.spark, self.root, self.fold, self.manifest = spark, root.rstrip("/"), fold, Manifest(spark, root)

    def _state(self, state: State) -> State:
        return state or {"snapshot": None, "tail": [], "batches": 0}

    def append(self, events: DataFrame) -> int:
        """Add a batch; returns its number."""
        path = f"{self.root}/batch-{uuid.uuid4().hex}"
        events.write.parquet(path)
        new = self.manifest.change(lambda s: self._state(s) | {"tail": [*self._state(s)["tail"], path], "batches": self._state(s)["batches"] + 1})
        return new["batches"]

    def tail(self) -> DataFrame | None:
        """The events after the snapshot; None if there are none."""
        paths = self._state(self.manifest.last()[1])["tail"]
        return self.spark.read.parquet(*paths) if paths else None

    def _all(self, state: State) -> DataFrame | None:
        parts = [self.spark.read.parquet(state["snapshot"])] if state["snapshot"] else []
        parts += [self.spark.read.parquet(*state["tail"])] if state["tail"] else []
        return reduce(DataFrame.unionByName, parts) if parts else None

    def replay(self) -> DataFrame | None:
        """The fold of all events: of the snapshot and the tail. None for an empty log."""
        rows = self._all(self._state(self.manifest.last()[1]))
        return None if rows is None else self.fold(rows)

    def compact(self) -> bool:
        """Make a snapshot of all there is; false if there was no tail."""
        state = self._state(self.manifest.last()[1])
        if not state["tail"]:
            return False
        path, taken = f"{self.root}/snapshot-{uuid.uuid4().hex}", set(state["tail"])
        self.fold(self._all(state)).write.parquet(path)

        def swapped(now: State) -> State:
            if now["snapshot"] != state["snapshot"]:
                raise RuntimeError("another writer compacted meanwhile")
            return now | {"snapshot": path, "tail": [p for p in now["tail"] if p not in taken]}

        self.manifest.change(swapped)
        return True
