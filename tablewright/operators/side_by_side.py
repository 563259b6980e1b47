"""Work on one data set side by side: a bounded pool of driver threads, each with its own scheduler pool and job group.

Spark shares its executors among the jobs of all threads; with ``spark.scheduler.mode`` FAIR each gets its part. A piece of work that fails is a
result with its error, and the others go on. ``cancel`` stops the jobs that run and all work that has not begun.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Threads of a pool.
THREADS = 4


@dataclass(frozen=True)
class Outcome:
    """What a piece of work returned, or its error as text; and how long it took."""

    name: str
    value: object | None
    error: str | None
    seconds: float


class SideBySide:
    """Runs pieces of work by name; one use."""

    def __init__(self, spark: SparkSession, threads: int = THREADS):
        self.spark, self.threads, self.run, self.stopped = spark, threads, uuid.uuid4().hex, threading.Event()
        self.names: list[str] = []

    def group(self, name: str) -> str:
        return f"{self.run}-{name}"

    def __call__(self, work: dict[str, Callable[[], object]]) -> list[Outcome]:
        """The outcomes in the order of ``work``. An interrupt of the caller cancels everything."""
        self.names = list(work)
        with ThreadPoolExecutor(max(1, min(self.threads, len(work)))) as pool:
            begun = [pool.submit(inheritable_thread_target(self.spark)(self._one), name, f) for name, f in work.items()]
            try:
                return [x.result() for x in begun]
            except BaseException:
                self.cancel()
                raise

    def _one(self, name: str, work: Callable[[], object]) -> Outcome:
        context, began = self.spark.sparkContext, time.monotonic()
        if self.stopped.is_set():
            return Outcome(name, None, "cancelled", 0.0)
        context.setLocalProperty("spark.scheduler.pool", name)
        context.setJobGroup(self.group(name), name, interruptOnCancel=True)
        try:
            return Outcome(name, work(), None, time.monotonic() - began)
        except Exception as error:  # the others go on
            return Outcome(name, None, "cancelled" if self.stopped.is_set() else f"{type(error).__name__}: {error}"[:2000], time.monotonic() - began)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
            context.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> None:
        self.stopped.set()
        for name in self.names:  # also those whose first job has not begun
            self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.group(name))


@contextmanager
def kept(*frames: DataFrame):
    """The frames in memory (and on disk beyond it) for a while."""
    held = [f.persist() for f in frames]
    try:
        yield held
    finally:
        for f in held:
            f.unpersist()
