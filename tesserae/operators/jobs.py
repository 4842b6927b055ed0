"""Background jobs as Spark job groups: start, follow, cancel."""

from __future__ import annotations

import threading
import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass
class Job:
    id: str
    kind: str
    status: str = "running"
    result: object = None
    error: str = ""
    events: list[dict] = field(default_factory=list)
    done: threading.Event = field(default_factory=threading.Event)


class Jobs:
    """Each job runs in its own thread and job group, so cancelling stops its Spark tasks alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.all = spark, {}

    def start(self, kind: str, work: Callable[[Callable[..., None]], object]) -> Job:
        """``work`` gets a function that reports progress, and its value is the job's result."""
        job = Job(uuid.uuid4().hex[:12], kind)
        self.all[job.id] = job

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job.id, kind, interruptOnCancel=True)
            try:
                job.result = work(lambda **e: job.events.append(e))
                job.status = "cancelled" if job.status == "cancelling" else "done"
            except Exception:  # a job's failure is its result
                job.error = traceback.format_exc()
                job.status = "cancelled" if job.status == "cancelling" else "failed"
            finally:
                job.done.set()

        InheritableThread(target=run, daemon=True).start()
        return job

    def cancel(self, job_id: str) -> None:
        self.all[job_id].status = "cancelling"
        self.spark.sparkContext.cancelJobGroup(job_id)
