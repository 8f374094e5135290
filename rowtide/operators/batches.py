"""Batches by count and time, duplicate tolerance, and batch outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rowtide.operators.replay import VIOLATIONS
from rowtide.operators.sequence import RANGE_BITS, with_position

# Default batch size and flush interval.
DEFAULT_BATCH_SIZE = 100
FLUSH_INTERVAL = "5 seconds"


def count_batches(
    df: DataFrame, n: int = DEFAULT_BATCH_SIZE, seq: str = "seq", bits: int = RANGE_BITS
) -> DataFrame:
    """Append ``batch_id``: rows in sequence order, ``n`` per batch, the last one partial."""
    placed = with_position(df, seq, name="__position", bits=bits)
    return placed.select(
        *df.columns, F.floor((F.col("__position") - 1) / n).cast("bigint").alias("batch_id")
    )


def time_batches(df: DataFrame, ts: str = "timestamp", interval: str = FLUSH_INTERVAL) -> DataFrame:
    """Append ``batch_start``: the interval of ``ts`` a row is flushed with."""
    return df.withColumn("batch_start", F.window(F.col(ts), interval)["start"])


def dedup_events(df: DataFrame, key: Sequence[str] = ("id",), seq: str = "seq") -> DataFrame:
    """One row per key, the earliest delivery.

    A combinable aggregate: of a group of copies, however large, each partition
    passes on one.
    """
    first = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), seq).alias("__first"))
    return first.select("__first.*")


def dedup_stream(events: DataFrame, key: str = "id", late: str = "1 hour") -> DataFrame:
    """Streaming form: copies that arrive within ``late`` of each other count once.

    The watermark is on the instant of arrival, so an event is never dropped
    for its own age.
    """
    arrived = events.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", late)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("__arrived")


def batch_outcome(df: DataFrame, batch: str = "batch_id", seq: str = "seq") -> DataFrame:
    """Per batch: rows, whether it commits, and the earliest error.

    Needs a ``violation`` column, NULL for good rows.
    """
    # the reason travels as its list position, which keeps the aggregate hashed
    code = F.array_position(F.array(*[F.lit(v) for v in VIOLATIONS]), F.col("violation"))
    failed_at = F.when(F.col("violation").isNotNull(), F.col(seq))
    grouped = df.select(F.col(batch), code.alias("__code"), failed_at.alias("__at")).groupBy(batch).agg(
        F.count("*").alias("rows"),
        F.count("__at").alias("bad_rows"),
        F.min("__at").alias("error_seq"),
        F.min_by("__code", "__at").alias("__code"),
    )
    return grouped.select(
        batch,
        "rows",
        "bad_rows",
        (F.col("bad_rows") == 0).alias("ok"),
        "error_seq",
        F.get(F.array(*[F.lit(v) for v in VIOLATIONS]), (F.col("__code") - 1).cast("int")).alias("first_error"),
    )


def failing_batches(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    return df.where(F.col("violation").isNotNull()).select(batch).distinct()


def committed_rows(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of batches without a violation."""
    return df.join(failing_batches(df, batch), batch, "left_anti")


def isolated_rows(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of failing batches, kept for a later run."""
    return df.join(failing_batches(df, batch), batch, "left_semi")
