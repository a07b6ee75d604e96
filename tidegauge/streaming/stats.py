"""Figures of a stream's micro-batches, observed as the rows pass and collected by a listener."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "batch_stats"
SCHEMA = "batch_id bigint, rows bigint, bytes bigint"


def observed(topic: DataFrame) -> DataFrame:
    """The rows of a topic stream; their number and key plus value bytes are counted on the way."""
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    return topic.observe(NAME, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


class BatchStats(StreamingQueryListener):
    """Keeps the figures of the last ``kept`` micro-batches of the queries that are ``observed``."""

    def __init__(self, kept: int = 10_000) -> None:
        self._rows: deque = deque(maxlen=kept)
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(NAME)
        if found is not None and progress.numInputRows:
            with self._changed:
                self._rows.append((str(progress.id), progress.batchId, found["rows"], found["bytes"] or 0))

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Until the listener has heard of the end of a run: its events come on their own thread."""
        with self._changed:
            if not self._changed.wait_for(lambda: run_id in self._ended, seconds):
                raise TimeoutError("the listener has not heard of the end of the query")

    def rows(self, query_id: str) -> list[tuple[int, int, int]]:
        with self._changed:
            return [r[1:] for r in self._rows if r[0] == query_id]


def stats_stream(topic: DataFrame, checkpoint: str, available_now: bool = True):
    """A consumer of its own that only counts; a ``BatchStats`` listener hears what it has counted."""
    writer = observed(topic).writeStream.format("noop").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_stats(spark: SparkSession, topic: DataFrame, checkpoint: str) -> DataFrame:
    """``batch_id, rows, bytes`` of all that is there, one row per micro-batch."""
    listener = BatchStats()
    spark.streams.addListener(listener)
    try:
        query = stats_stream(topic, checkpoint)
        query.awaitTermination()
        listener.wait(str(query.runId))
        return spark.createDataFrame(listener.rows(str(query.id)), SCHEMA)
    finally:
        spark.streams.removeListener(listener)
