"""A flow: decode a stream of messages and write each micro-batch to its sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from rowtide.functions.frames import read_or_empty
from rowtide.operators import envelope
from rowtide.operators.batches import FLUSH_INTERVAL
from rowtide.session import drop_folder, work_dir
from rowtide.sources.changes import ARRIVAL, number_arrivals
from rowtide.streaming.live import FlowLog

REJECTS = "seq BIGINT, reason STRING, payload STRING, error STRING, stream STRING, batch BIGINT"


def fan_out(events: DataFrame, batch_id: int, sinks: Sequence, rejected: int = 0, stream: str = "") -> list[bool]:
    """The same batch to every sink in order; events are computed once.

    A sink that raises stops the round. The batch is then delivered again to
    all sinks, and those that have it already skip it.
    """
    events.persist()
    try:
        return _to_sinks(events, batch_id, sinks, rejected, stream)
    finally:
        events.unpersist()


def _to_sinks(events: DataFrame, batch_id: int, sinks: Sequence, rejected: int, stream: str) -> list[bool]:
    return [sink.apply(events, batch_id, rejected, stream) for sink in sinks]


def run_flow(
    source: DataFrame,
    sinks: Sequence,
    checkpoint: str,
    rejects_path: str | None = None,
    decode: Callable[[DataFrame], DataFrame] = envelope.decode_envelope,
    available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
    name: str | None = None,
    log: FlowLog | None = None,
) -> StreamingQuery:
    """Start the flow; ``stop()`` the returned query to pause it.

    Starting again with the same ``checkpoint`` resumes after the last
    completed batch; a batch that failed midway keeps its number and is
    written again. ``available_now`` drains the source and stops, the last
    partial batch included.

    With ``log`` the messages of a batch are counted as they are decoded, and
    no job is run for the count: the log has the rejects of each batch, the
    sinks then take them as none. Bare lines are numbered batch by batch and
    cannot be logged so.
    """
    arrival = set(ARRIVAL) <= set(source.columns)
    if log is not None:
        if arrival:
            raise ValueError("a flow of bare lines has no live log")
        source = log.observed(decode(source))

    known = []

    def stream_id(batch: DataFrame) -> str:
        # what Spark itself wrote into the checkpoint when the stream began there
        if not known:
            metadata = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()
            known.append(json.loads(metadata["value"])["id"])
        return known[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch)
        if log is not None:
            write_observed(batch, batch_id, stream)
            return
        if arrival:
            batch = number_arrivals(batch, batch_id)
        # kept once, routed and keyed; the message only of those that are rejected
        decoded = decode(batch)
        message = F.when(F.col("reject_reason").isNotNull(), F.col("payload"))
        rows = envelope.change_rows(decoded.withColumn("__message", message).drop("payload")).persist()
        try:
            rejects = envelope.split_rejects(rows.withColumn("payload", F.col("__message")))[1]
            rejected = rejects.count()
            if rejects_path is not None and rejected:
                rejects.write.mode("overwrite").parquet(f"{rejects_path}/stream={stream}/batch={batch_id}")
            events = rows.where(F.col("reject_reason").isNull()).drop("reject_reason", "__message")
            _to_sinks(events, batch_id, sinks, rejected, stream)
        finally:
            rows.unpersist()

    def write_observed(batch: DataFrame, batch_id: int, stream: str) -> None:
        # written, so that each row passes the counts once, whatever reads it and whichever executors are lost
        path = work_dir(batch.sparkSession, "batch")
        try:
            batch.write.parquet(path)
            good, rejects = envelope.split_rejects(batch.sparkSession.read.schema(batch.schema).parquet(path))
            if rejects_path is not None:
                rejects.write.mode("overwrite").parquet(f"{rejects_path}/stream={stream}/batch={batch_id}")
            fan_out(envelope.change_rows(good), batch_id, sinks, 0, stream)
        finally:
            drop_folder(batch.sparkSession, path)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if name is not None:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_rejects(spark, path: str) -> DataFrame:
    return read_or_empty(spark, path, REJECTS)
