"""Ids of all events seen, so that a copy counts once however much later it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.functions.frames import read_or_empty
from rowtide.operators.batches import dedup_events

# Day under which events without a time are kept.
_NO_TIME = "none"


class SeenEvents:
    """Ids in folders by batch and by day of the event.

    A copy carries its event's id and time, so a batch is compared with the
    days of its own events alone, be they recent or old. Nothing expires. A
    batch that is delivered again is judged as the first time: its own ids do
    not count, and its folder is written anew.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "id", at: str = "timestamp", seq: str = "seq"):
        self.spark, self.root, self.key, self.at, self.seq = spark, root.rstrip("/"), key, at, seq

    def known(self, id_type: str = "string") -> DataFrame:
        return read_or_empty(self.spark, self.root, f"`{self.key}` {id_type}, batch BIGINT, day STRING")

    def fresh(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The events of a batch not seen before, one per id, and takes note of them.

        The result is read twice or more when it is written on; persist the
        batch before, as a flow does.
        """
        # ids are judged without the rest of their events, which is shuffled once, to its ids
        at = batch.select(self.key, self.seq, F.to_date(self.at).alias("__date"))
        day = F.coalesce(F.col("__date").cast("string"), F.lit(_NO_TIME)).alias("day")
        first = at.groupBy(self.key).agg(F.min_by("__date", self.seq).alias("__date")).select(self.key, day)
        # a batch spans few days, far fewer than it has events
        days = [r["day"] for r in first.select("day").distinct().collect()]
        known = self.known(dict(batch.dtypes)[self.key])
        before = known.where(F.col("day").isin(days) & (F.col("batch") != batch_id))
        # Spark puts a Bloom filter of the batch's ids before this join's shuffle where the id table is large
        again = before.join(first.select(self.key), self.key, "left_semi").select(self.key)
        ids = first.join(again, first[self.key].eqNullSafe(again[self.key]), "left_anti")
        ids.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/batch={batch_id}")
        noted = self.known(dict(batch.dtypes)[self.key]).where(F.col("batch") == batch_id).select(self.key)
        events = dedup_events(batch, (self.key,), self.seq)
        return events.join(noted, events[self.key].eqNullSafe(noted[self.key]), "left_semi")
