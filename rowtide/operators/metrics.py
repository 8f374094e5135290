"""Flow statistics over a batch log.

The log is ``(flow, sink, batch_id, started_at, ended_at, rows_in,
rows_rejected, rows_written, ok, error)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.text import format_uptime
from rowtide.operators.lookup import keep_last_n
from rowtide.operators.sequence import RANGE_BITS, with_run_length

# Defaults, and the texts of an alert.
FAILURE_THRESHOLD = 20
CHART_POINTS = 30
ALERT_SUBJECT = "[CDC Alert] Flow '%s' stopped due to errors"
ALERT_DETAILS = "Destination %s\nConsecutive errors: %d\nError: %s"


def flow_stats(log: DataFrame, now: Column | None = None, since: Column | None = None) -> DataFrame:
    """Totals, last error and uptime per flow and sink.

    ``since`` resets the counters: batches that ended up to then are left out.
    """
    counted = log if since is None else log.where(F.col("ended_at") > since)
    at = F.current_timestamp() if now is None else now
    failed = F.when(~F.col("ok"), F.col("batch_id"))
    totals = counted.groupBy("flow", "sink").agg(
        F.sum("rows_in").alias("received"),
        F.sum("rows_written").alias("written"),
        F.sum("rows_rejected").alias("rejected"),
        F.count(failed).alias("errors"),
        F.max_by(F.when(~F.col("ok"), F.col("error")), failed).alias("last_error"),
        F.min("started_at").alias("__started"),
    )
    uptime = F.unix_seconds(at) - F.unix_seconds("__started")
    return totals.withColumn("uptime_seconds", uptime).drop("__started").withColumn(
        "uptime_text", format_uptime(F.col("uptime_seconds"))
    )


def flow_received(log: DataFrame) -> DataFrame:
    """Messages received per flow, each batch once however many sinks it went to."""
    per_batch = log.groupBy("flow", "batch_id").agg(F.max("rows_in").alias("rows_in"))
    return per_batch.groupBy("flow").agg(F.sum("rows_in").alias("messages_received"))


def failure_streaks(log: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """Append ``streak``: consecutive failures of the sink up to each batch."""
    return with_run_length(log, ~F.col("ok"), ["flow", "sink"], "streak", seq="batch_id", bits=bits)


def threshold_alerts(log: DataFrame, n: int = FAILURE_THRESHOLD, bits: int = RANGE_BITS) -> DataFrame:
    """One alert per streak, at the batch where it reaches ``n``."""
    reached = failure_streaks(log, bits).where(F.col("streak") == n)
    return reached.select(
        "flow",
        "sink",
        "batch_id",
        "streak",
        "error",
        F.lit(True).alias("stop"),
        F.format_string(ALERT_SUBJECT, "flow").alias("subject"),
        F.format_string(ALERT_DETAILS, "sink", "streak", "error").alias("details"),
    )


def throughput(
    events: DataFrame, ts: str = "timestamp", interval: str = "1 minute", late: str | None = None
) -> DataFrame:
    """Events per interval; ``late`` sets the watermark of a stream.

    With ``late`` a stream gives up an interval that long after its end, and
    events that come later still are left out of the counts; without, it keeps
    every interval.
    """
    source = events if late is None else events.withWatermark(ts, late)
    grouped = source.groupBy(F.window(F.col(ts), interval).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("interval_start"), "n")


def newest_points(series: DataFrame, order: str = "interval_start", n: int = CHART_POINTS) -> DataFrame:
    return keep_last_n(series, n, order)
