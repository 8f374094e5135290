"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index holds one row per text ever kept: its SHA-256, the id that stays and
the number of rows it came with. A new batch is reduced to one row per digest
before any shuffle, checked against the index with a sort-merge anti join on
the index's own buckets, and what is new is appended. Whatever the share of a
single text, only (id, digest) rows meet it, in a join that can be split.

Defined results: a null text equals the empty text. Among equal texts of one
batch the largest id stays (null only when no row has an id); against earlier
batches the one in the index stays. Rows that agree in id and text count as
one document's repeats: one of them is kept, all are reported. Ingesting a
batch again gives the same answer and appends nothing. Only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm.common import id_and_text, prepare
from rowtide.session import materialize, work_dir


def digest_of(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))


class DigestIndex:
    """Digests of kept texts at ``location``, in ``buckets`` sorted buckets; a later session opens it again."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location, self.buckets = prepare(spark), location, buckets
        self.name = "digest_index_" + hashlib.md5(location.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        groups.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").sortWithinPartitions(
            "digest"
        ).write.insertInto(self.name)

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Decide every row of ``docs`` and add its new texts.

        Returns ``doc_id, digest, keep_id, group_size, kept``, one row per row;
        ``group_size`` counts rows of this batch.
        """
        rows = id_and_text(docs).select("doc_id", digest_of().alias("digest"))
        rows = materialize(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "digests")
        groups = materialize(
            rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups"
        )
        self.append(groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti"))
        decided = groups.select("digest", "group_size").join(
            self.table().select("digest", "keep_id").hint("merge"), "digest"
        )
        # Written so that the last join has a plain shuffle on both sides, which a hot digest needs to be split.
        decided = materialize(decided, "decided")
        stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return rows.join(decided, "digest").select(
            "doc_id", "digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), stays.alias("s")
        ).select("doc_id", "digest", "keep_id", "group_size", (F.col("s") & (F.col("copy") == 1)).alias("kept"))


def drop_duplicates(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per text new to the index."""
    kept = index.ingest(docs).where("kept").select("doc_id", "digest")
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("__id"), digest_of().alias("__digest"), F.struct("*").alias("__row")
    )
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest"))
    same = F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__digest") == F.col("__kept_digest"))
    return whole.join(kept, same, "left_semi").dropDuplicates(["__id", "__digest"]).select("__row.*")


def new_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An empty index below the shared working folder."""
    return DigestIndex(spark, work_dir(spark, "digest-index"), buckets)
