"""Running a report's jobs: one at a time, with a time limit, and to be killed from another thread."""

from __future__ import annotations

import enum
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from lattica.errors import ExecutionKilled, ExecutionLocked, QueryTimeout

R = TypeVar("R")


class State(enum.Enum):
    READY = "ready"
    QUERYING = "querying"
    KILLED = "killed"


class Execution:
    """The state of one report's jobs, which carry a tag of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.state, self.lock = spark, f"lattica-{uuid.uuid4().hex}", State.READY, threading.Lock()
        self.ended = threading.Event()

    def _interrupt(self) -> None:
        """Cancel the action's jobs until it ends: at first none may have been submitted yet."""
        while not self.ended.is_set():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self.ended.wait(0.2)

    def run(self, action: Callable[[], R], timeout: float | None = None, label: str | None = None) -> R:
        """The action's result. QueryTimeout after timeout seconds, ExecutionKilled after kill(); it may run again after either."""
        with self.lock:
            if self.state is State.QUERYING:
                raise ExecutionLocked("the report is running")
            self.state = State.QUERYING
            self.ended.clear()
        late = threading.Event()

        def stop() -> None:
            late.set()
            self._interrupt()

        timer = threading.Timer(timeout, stop) if timeout else None
        self.spark.sparkContext.addJobTag(self.tag)
        if label:
            self.spark.sparkContext.setJobDescription(label)
        try:
            if timer:
                timer.start()
            out = action()
        except Exception as e:
            if late.is_set():
                raise QueryTimeout(f"over {timeout} seconds") from e
            if self.state is State.KILLED:
                raise ExecutionKilled("the report was killed") from e
            raise
        finally:
            self.ended.set()
            if timer:
                timer.cancel()
            self.spark.sparkContext.removeJobTag(self.tag)
            if label:
                self.spark.sparkContext.setJobDescription(None)
            with self.lock:
                killed, self.state = self.state is State.KILLED, State.READY
        if killed:
            raise ExecutionKilled("the report was killed")
        if late.is_set():
            raise QueryTimeout(f"over {timeout} seconds")
        return out

    def kill(self) -> bool:
        """Interrupt what runs; False if nothing does."""
        with self.lock:
            if self.state is not State.QUERYING:
                return False
            self.state = State.KILLED
        threading.Thread(target=self._interrupt, daemon=True).start()
        return True
