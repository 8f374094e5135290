"""The batch log of flows, from what their micro-batches observe of themselves.

The counts are taken while a batch is read for its sinks, so no job is run for
them; Spark hands them to a listener when the batch has ended.
"""

from __future__ import annotations

import threading
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from rowtide.functions.frames import read_or_empty

# Layout of the log, as ``operators.metrics`` reads it.
BATCHES = (
    "flow STRING, sink STRING, batch_id BIGINT, started_at TIMESTAMP, ended_at TIMESTAMP, rows_in BIGINT, "
    "rows_rejected BIGINT, rows_written BIGINT, ok BOOLEAN, error STRING"
)


class FlowLog(StreamingQueryListener):
    """Writes one row per completed batch of each flow that is run with it.

    Rows lie in a folder of their stream and batch, so a batch that is run
    again after a crash replaces its row. Batches without messages, and those
    that never end, have none. The log hears of a batch shortly after its end;
    ``wait`` returns when it has heard of all of a query that has stopped.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/batches"
        self.counts = f"flow_log_{uuid.uuid4().hex}"  # tells this log's flows from others of the session
        self.ended: dict[str, threading.Event] = {}
        self.problems: list[Exception] = []
        spark.streams.addListener(self)

    def observed(self, decoded: DataFrame) -> DataFrame:
        """The same rows of a stream, counted as they pass."""
        rejected = F.count(F.when(F.col("reject_reason").isNotNull(), 1))
        return decoded.observe(self.counts, F.count(F.lit(1)).alias("rows_in"), rejected.alias("rows_rejected"))

    def onQueryStarted(self, event) -> None:
        self._end(event)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counts = progress.observedMetrics.get(self.counts)
        if counts is None or not counts["rows_in"]:
            return
        started = datetime.fromisoformat(progress.timestamp)
        ended = started + timedelta(milliseconds=progress.durationMs["triggerExecution"])
        row = (progress.name, None, progress.batchId, started, ended, counts["rows_in"], counts["rows_rejected"], None, True, None)
        place = f"{self.path}/stream={progress.id}/batch={progress.batchId}"
        try:
            self.spark.createDataFrame([row], BATCHES).coalesce(1).write.mode("overwrite").parquet(place)
        except Exception as problem:  # Spark only logs what a listener raises; ``wait`` raises it
            self.problems.append(problem)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event).set()

    def _end(self, event) -> threading.Event:
        return self.ended.setdefault(str(event.runId), threading.Event())

    def wait(self, query, seconds: float = 60) -> None:
        """Wait until the log has every batch of a query that has stopped."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"the log did not hear of the end of {query.name} within {seconds} seconds")
        if self.problems:
            raise self.problems[0]

    def rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, BATCHES + ", stream STRING, batch BIGINT").drop("batch")

    def close(self) -> None:
        self.spark.streams.removeListener(self)
