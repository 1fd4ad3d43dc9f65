"""Indexing that tells how far it is and can be called off."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Points of progress between two reports.
STEP = 5


def percent(done: int, total: int) -> int:
    """5 to 95 while rows are being indexed; 100 is for the end."""
    return min(99, 5 + done * 90 // total if total > 0 else 95)


class Progress(StreamingQueryListener):
    """Adds up the rows of one stream's batches and calls ``tell(percent)`` where it advanced by ``STEP`` points or more, or reached the end."""

    def __init__(self, name: str, total: int, tell):
        self.name, self.total, self.tell, self.done, self.last, self.query_id = name, total, tell, 0, 0, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.query_id = str(event.id)

    def onQueryProgress(self, event) -> None:
        if event.progress.name != self.name or not event.progress.numInputRows:
            return
        self.done += event.progress.numInputRows
        now = percent(self.done, self.total)
        if now - self.last >= STEP or self.done >= self.total:
            self.last = now
            self.tell(now)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class IndexJob:
    """One upload being indexed: ``source``, a stream of its chunks, goes batch by batch to ``write(batch, batch_id)``.

    ``steps`` are the percentages told, each at least ``STEP`` after the one before; ``state`` is new, indexing, ready, cancelled or failed.  ``cancel`` stops
    the stream and the jobs that it runs at the moment, which carry the job's tag; batches that are written stay, and the checkpoint lets a later job go on after them."""

    def __init__(self, spark: SparkSession, job_id: str, total: int, tell=None):
        self.spark, self.tag, self.total = spark, f"index-{job_id}", total
        self.state, self.steps, self.error = "new", [], None
        self._tell, self._query, self._lock = tell, None, threading.Lock()

    def _step(self, at: int) -> None:
        self.steps.append(at)
        if self._tell:
            self._tell(at)

    def start(self, source: DataFrame, write, checkpoint: str) -> IndexJob:
        context = self.spark.sparkContext
        self._listener = Progress(self.tag, self.total, self._step)
        self.spark.streams.addListener(self._listener)
        context.addJobTag(self.tag)  # a stream inherits the tags of the thread that starts it
        try:
            with self._lock:
                self.state = "indexing"
                self._step(STEP)
                self._listener.last = STEP
                self._query = source.writeStream.queryName(self.tag).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        finally:
            context.removeJobTag(self.tag)
        return self

    def cancel(self) -> bool:
        """Whether there was something to call off."""
        with self._lock:
            if self.state != "indexing" or not self._query.isActive:
                return False
            self.state = "cancelled"
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        self._query.stop()
        return True

    def wait(self, timeout: float | None = None) -> str:
        """The state in the end."""
        try:
            over = self._query.awaitTermination(timeout) if timeout is not None else self._query.awaitTermination() or True
        except Exception as e:  # the stream's own failure, or what calling it off did to its jobs
            over, self.error = True, e
        if over:
            # Events are told in order and after the fact.
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            self.spark.streams.removeListener(self._listener)
            with self._lock:
                if self.state == "indexing":
                    self.state = "failed" if self.error else "ready"
            if self.state == "ready":
                self._step(100)
        return self.state


def cancel(spark: SparkSession, job_id: str) -> None:
    """Call off the jobs of an upload from anywhere on the driver."""
    spark.sparkContext.cancelJobsWithTag(f"index-{job_id}")
