"""A log of what a running job has done, every few seconds."""

from __future__ import annotations

import logging
import threading
import time

from pyspark.sql import SparkSession

log = logging.getLogger("chainloom.progress")


class Progress:
    """Within the block a thread logs the finished and all tasks of the stages that run; at its end done() logs the rate.

    with Progress(spark) as p:
        ...
        p.done(n_blocks, "blocks")
    """

    def __init__(self, spark: SparkSession, seconds: float = 10.0):
        self.tracker, self.seconds = spark.sparkContext.statusTracker(), seconds
        self.stop, self.began = threading.Event(), time.monotonic()

    def __enter__(self):
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.stop.set()
        self.thread.join()

    def tasks(self) -> tuple[int, int]:
        """(finished, all) tasks of the running stages."""
        infos = [self.tracker.getStageInfo(s) for s in self.tracker.getActiveStageIds()]
        return sum(i.numCompletedTasks for i in infos if i), sum(i.numTasks for i in infos if i)

    def _run(self) -> None:
        while not self.stop.wait(self.seconds):
            finished, all_tasks = self.tasks()
            log.info("%d of %d tasks of the running stages after %.0f s", finished, all_tasks, time.monotonic() - self.began)

    def done(self, n: int, what: str) -> float:
        """Logs and returns the rate of n things since the start."""
        rate = n / max(time.monotonic() - self.began, 1e-9)
        log.info("%d %s, %.1f a second", n, what, rate)
        return rate
