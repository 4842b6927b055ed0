"""Numbered states of a stored table, committed by whoever writes a number first.

A state is a small JSON file that names folders which are written once. A writer reads the last state,
writes its folders, and creates the next number without overwriting; if another writer was faster, it
reads again and puts its change on top. So no writer's change is lost and readers see whole states.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

State = dict[str, Any]


class Manifest:
    """States under ``root``, which any Hadoop path may be."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/states"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _number(self, n: int) -> object:
        return self._path(f"{self.folder}/{n:012d}.json")

    def last(self) -> tuple[int, State]:
        """The last number and its state; 0 and nothing if there is none."""
        folder = self._path(self.folder)
        if not self._fs.exists(folder):
            return 0, {}
        numbers = [int(f.getPath().getName()[:12]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return 0, {}
        for _ in range(50):  # a number may be seen before its few bytes are
            stream = self._fs.open(self._number(max(numbers)))
            try:
                held = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if held.endswith("\n"):
                return max(numbers), json.loads(held)
            time.sleep(0.1)
        raise RuntimeError(f"state {max(numbers)} was never finished")

    def commit(self, after: int, state: State) -> bool:
        """Make ``state`` the one that follows number ``after``; false if that number is taken."""
        try:
            stream = self._fs.create(self._number(after + 1), False)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        stream.write(bytearray((json.dumps(state, sort_keys=True) + "\n").encode()))
        stream.close()
        return True

    def change(self, make: Callable[[State], State], tries: int = 100) -> State:
        """Put a change on top of the last state, anew for as long as other writers are faster."""
        for _ in range(tries):
            number, state = self.last()
            new = make(state)
            if self.commit(number, new):
                return new
        raise RuntimeError(f"other writers were faster {tries} times")
