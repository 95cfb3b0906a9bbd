"""Cancellation: a run's jobs carry a tag, its output appears only when all of it is there."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


class Cancelled(Exception):
    """The run was cancelled before its work ended."""


class Run:
    """Work that another thread may cancel. Its jobs end, which frees their executor slots, and its streams stop; what it wrote so far goes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tag = spark, f"run-{uuid.uuid4().hex}"
        self._lock, self._cancelled, self._queries = threading.Lock(), False, []

    @contextmanager
    def _tagged(self) -> Iterator[None]:
        self._check()
        context = self.spark.sparkContext
        context.addJobTag(self.tag)  # of this thread alone
        try:
            yield
        except Exception as e:
            if self._cancelled:
                raise Cancelled(self.tag) from e
            raise
        finally:
            context.removeJobTag(self.tag)

    def _check(self) -> None:
        if self._cancelled:
            raise Cancelled(self.tag)

    def active(self) -> bool:
        """Whether jobs or streams of this run are at work."""
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        return bool(len(list(tracker.getJobIdsForTag(self.tag)))) and any(j in set(tracker.getActiveJobIds()) for j in tracker.getJobIdsForTag(self.tag)) or any(q.isActive for q in self._queries)

    def cancel(self) -> None:
        """End all of the run; it starts nothing more. What has ended stays as it is."""
        with self._lock:
            self._cancelled = True
            queries = list(self._queries)
        for query in queries:
            query.stop()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, path: str) -> None:
        """df as Parquet at a path that isn't there yet: written beside it and renamed when it is whole."""
        fs, target = self._path(path)
        if fs.exists(target):
            raise FileExistsError(path)
        _, part = self._path(f"{path.rstrip('/')}.{self.tag}")
        try:
            with self._tagged():
                df.write.parquet(str(part.toString()))
                with self._lock:  # from here on it is too late to cancel
                    self._check()
                    if not fs.rename(part, target):
                        raise FileExistsError(path)
        finally:
            if fs.exists(part):
                fs.delete(part, True)

    def start(self, writer: DataStreamWriter) -> StreamingQuery:
        """A stream that stops when the run is cancelled; its checkpoint lets another run go on."""
        with self._lock:
            self._check()
            query = writer.start()
            self._queries.append(query)
        return query
