"""Keyed checks, lookups and merges between tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowtide.functions.events import merge_changes
from rowtide.functions.frames import read_or_empty
from rowtide.functions.json_text import parse_object_typed
from rowtide.operators.sequence import number_rows


def missing_refs(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose reference is set but not found."""
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def missing_array_refs(child: DataFrame, key: str, refs: str, parent: DataFrame, pk: str) -> DataFrame:
    """``(key, missing, problem)``: array elements without a parent, and empty arrays."""
    keys = parent.select(F.col(pk).alias("missing")).distinct()
    absent = (
        child.select(key, F.explode(refs).alias("missing"))
        .join(keys, "missing", "left_anti")
        .select(key, "missing", F.lit("not_found").alias("problem"))
    )
    empty = child.where(F.col(refs).isNull() | (F.size(refs) == 0)).select(
        key, F.lit(None).cast(absent.schema["missing"].dataType).alias("missing"), F.lit("empty").alias("problem")
    )
    return absent.unionByName(empty)


def references_to(parent: DataFrame, pk: str, child: DataFrame, fk: str, name: str) -> DataFrame:
    """Parent keys in use with each child name once: ``(pk, name)``.

    ``fk`` may be an array column. Rows, not one text per parent: a parent
    that everything refers to would otherwise become one row of any size.
    """
    reference = child.select(_reference(child, fk).alias(pk), F.col(name)).where(F.col(pk).isNotNull())
    return reference.join(parent.select(pk).distinct(), pk, "left_semi").distinct()


def reference_counts(references: DataFrame, pk: str) -> DataFrame:
    return references.groupBy(pk).agg(F.count("*").alias("n_refs"))


def references_text(references: DataFrame, pk: str, name: str, per_part: int = 1000) -> DataFrame:
    """``(pk, part, n_refs, names)``: sorted names joined by ", ", ``per_part`` to a row.

    Every name of every parent is there, in as many parts as it takes; parts
    are numbered from 0 in name order. Positions come from one sort of all
    references, so no task holds a parent's names together.
    """
    text = references.select(pk, F.col(name).cast("string").alias("__name"))
    placed = number_rows(text, [pk, "__name"], "__at")
    first = placed.groupBy(F.col(pk).alias("__pk")).agg(F.min("__at").alias("__first"), F.count("*").alias("n_refs"))
    joined = placed.join(first, F.col(pk) == F.col("__pk"))
    part = F.floor((F.col("__at") - F.col("__first")) / per_part).cast("bigint").alias("part")
    names = F.array_join(F.array_sort(F.collect_list("__name")), ", ").alias("names")
    return joined.groupBy(pk, part).agg(F.first("n_refs").alias("n_refs"), names)


def _reference(child: DataFrame, fk: str) -> Column:
    is_array = child.schema[fk].dataType.typeName() == "array"
    return F.explode(fk) if is_array else F.col(fk)


def delete_unreferenced(
    parent: DataFrame, pk: str, child: DataFrame, fk: str, doomed: Column
) -> tuple[DataFrame, DataFrame]:
    """Guarded delete: ``(kept, refused)``.

    Doomed rows go only when no child refers to them; refused ones stay.
    """
    used = child.select(_reference(child, fk).alias(pk)).where(F.col(pk).isNotNull()).distinct()
    flagged = parent.withColumn("__doomed", F.coalesce(doomed, F.lit(False)))
    refused = flagged.where("__doomed").join(used, pk, "left_semi").select(*parent.columns)
    kept = flagged.where(~F.col("__doomed")).select(*parent.columns).unionByName(refused)
    return kept, refused


def duplicate_keys(rows: DataFrame, key: str, target: DataFrame | None = None) -> DataFrame:
    """Keys that repeat within ``rows`` or exist in ``target``: ``(key, n, in_target)``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    if target is None:
        return counts.where(F.col("n") > 1).withColumn("in_target", F.lit(False))
    held = target.select(key).distinct().withColumn("__held", F.lit(True))
    marked = counts.join(held, key, "left").withColumn("in_target", F.coalesce("__held", F.lit(False)))
    return marked.where((F.col("n") > 1) | F.col("in_target")).drop("__held")


def list_by(df: DataFrame, key: str) -> DataFrame:
    """All rows in key order; the other columns break ties, so equal keys can be split."""
    return df.orderBy(key, *[c for c in df.columns if c != key])


def get_by(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def status_list(status: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """Running entities with their definition; those without one are dropped."""
    return status.join(definitions, name).withColumn("active", F.col("status") == "Running")


def status_of(definitions: DataFrame, status: DataFrame, name: str) -> DataFrame:
    """Every definition with its status, ``Stopped`` when it is not running."""
    joined = definitions.join(status.select(name, "status"), name, "left")
    filled = joined.withColumn("status", F.coalesce("status", F.lit("Stopped")))
    return filled.withColumn("active", F.col("status") == "Running")


def with_type(df: DataFrame, key: str, definitions: DataFrame, name: str, type_column: str) -> DataFrame:
    """Append the type looked up by name, NULL when unknown."""
    # No broadcast hint: Spark broadcasts the side when its size allows.
    types = definitions.select(F.col(name).alias(key), F.col(type_column))
    return df.join(types, key, "left")


def with_tag(df: DataFrame, tags: str, tag: str) -> DataFrame:
    return df.where(F.array_contains(tags, tag))


class TagPostings:
    """Inverted index of tag lists: ``(tag, key)`` in folders by hash of the tag, sorted by tag.

    A lookup opens one folder and skips the row groups of other tags. Inserts
    append; one that is repeated under its name replaces itself. ``key`` tells
    the indexed rows apart.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, key_type: str = "bigint", buckets: int = 64):
        self.spark, self.root, self.key, self.key_type, self.buckets = spark, root.rstrip("/"), key, key_type, buckets

    def _bucket(self, tag: Column) -> Column:
        return F.pmod(F.xxhash64(tag), F.lit(self.buckets)).cast("int")

    def insert(self, rows: DataFrame, tags: str, name: str) -> None:
        """Post the tags of new rows; null lists and null tags have no entry."""
        tag = F.explode(F.array_distinct(tags)).alias("tag")
        postings = rows.select(tag, F.col(self.key)).where(F.col("tag").isNotNull())
        placed = postings.withColumn("bucket", self._bucket(F.col("tag")))
        # a common tag is spread over the salts, a rare one costs as many files at most
        spread = placed.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(8)))
        ordered = spread.sortWithinPartitions("bucket", "tag")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/insert={name}")

    def keys(self, tag: str) -> DataFrame:
        """Keys of the rows with a tag."""
        layout = f"tag STRING, `{self.key}` {self.key_type}, insert STRING, bucket INT"
        postings = read_or_empty(self.spark, self.root, layout)
        return postings.where((F.col("bucket") == self._bucket(F.lit(tag))) & (F.col("tag") == tag)).select(self.key)

    def with_tag(self, df: DataFrame, tag: str) -> DataFrame:
        return df.join(self.keys(tag), self.key, "left_semi")


# Shares of a group above the grid's thresholds: 1/2, 1/4, ...
_GRID = [1 - 0.5**k for k in range(1, 14)]
_ACCURACY = 10_000
_ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def keep_last_n(df: DataFrame, n: int, order: str, by: str | None = None) -> DataFrame:
    """The newest ``n`` rows, overall or per group; rows without ``order`` are the oldest.

    Groups of more than ``2 * n`` rows are first cut by a threshold that at
    least ``n`` of their rows reach: one of the group's own quantiles, taken by
    a combinable sketch with a bounded error. What is ranked then is less than
    twice as many rows as wanted, but for ties and the sketch's error; groups
    so large that the error counts are cut again. An ``order`` without
    quantiles, such as text, is cut in salted parts, as many as make part and
    union equally large.
    """
    newest = F.col(order).desc()
    if by is None:
        return df.orderBy(newest).limit(n)
    sizes = df.groupBy(F.col(by).alias("__by")).agg(F.count(order).alias("__n"))
    large = sizes.where(F.col("__n") > 2 * n)
    most = large.agg(F.max("__n")).first()[0] or 0  # one number
    cut = df
    if most and dict(df.dtypes)[order] in _ORDERED:
        for _ in range(max(1, math.ceil(math.log(most / (2 * n), 4096)))):
            cut = _above_threshold(cut, n, order, by)
    elif most:
        salts = math.ceil(math.sqrt(most / n))
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(salts)))
        in_part = F.row_number().over(Window.partitionBy(by, "__salt").orderBy(newest))
        cut = salted.withColumn("__rank", in_part).where(F.col("__rank") <= n)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(newest))
    return cut.withColumn("__rank", rank).where(F.col("__rank") <= n).select(*df.columns)


def _above_threshold(df: DataFrame, n: int, order: str, by: str) -> DataFrame:
    """Rows that may be among the newest ``n`` of their group, by a quantile of each group of more than ``2 * n``."""
    sizes = df.groupBy(F.col(by).alias("__by")).agg(F.count(order).alias("__n")).where(F.col("__n") > 2 * n)
    # only these groups get a sketch
    chosen = df.join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    sketched = chosen.groupBy("__by").agg(F.max("__n").alias("__n"), F.percentile_approx(order, _GRID, _ACCURACY).alias("__grid"))
    wanted = n + 4 * F.col("__n") / _ACCURACY + 1
    # the highest quantile that surely leaves enough; none where even the lowest might not
    step = F.size(F.filter(F.array(*[F.lit(1 - q) for q in _GRID]), lambda share: share * F.col("__n") >= wanted))
    floors = sketched.select(F.col("__by").alias("__of"), F.get("__grid", step - 1).alias("__floor"))
    joined = df.join(floors, F.col(by).eqNullSafe(F.col("__of")), "left")
    return joined.where(F.col("__floor").isNull() | (F.col(order) >= F.col("__floor"))).select(*df.columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Target plus one row for each key it lacks.

    Of rows with one key the first by ``order`` is taken, NULLs last; the
    values of the other columns break ties.
    """
    fresh = rows.join(target.select(key).distinct(), key, "left_anti")
    rest = [c for c in rows.columns if c not in (key, order)]
    place = [] if order is None else [F.col(order).isNull().alias("__unordered"), F.col(order)]
    first = fresh.groupBy(key).agg(F.min(F.struct(*place, *rest)).alias("__first"))
    found = first.select(key, *[F.col("__first")[c].alias(c) for c in rows.columns if c != key])
    return target.unionByName(found.select(*target.columns))


def merge_audited(target: DataFrame, rows: DataFrame, key: str, now: Column, order: str | None = None) -> DataFrame:
    """Full-row update or insert: creation time is kept, update time is stamped.

    ``target`` has ``created_at`` and ``updated_at``; ``rows`` has the other
    columns. Of rows with one key the last by ``order`` is written, NULLs
    first; the values break ties.
    """
    values = [c for c in target.columns if c not in (key, "created_at", "updated_at")]
    place = [] if order is None else [F.col(order).alias("__order")]
    last = rows.groupBy(key).agg(F.max(F.struct(*place, *values)).alias("__last"))
    incoming = last.select(key, *[F.col("__last")[c].alias(f"__new_{c}") for c in values], F.lit(True).alias("__touched"))
    touched = F.coalesce("__touched", F.lit(False))
    joined = target.join(incoming, key, "full_outer")
    return joined.select(
        key,
        *[F.when(touched, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.coalesce("created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def append_event_log(events: DataFrame, source: str) -> DataFrame:
    """Routed events in the layout of the event log.

    ``data`` is what the event leaves: for updates the record with its changes
    put in. The changes themselves stay in their own column.
    """
    own, changed = parse_object_typed(F.col("record")), parse_object_typed(F.col("changes"))
    merged = F.to_json(merge_changes(F.lit("update"), own, changed))
    is_changed = (F.col("op") == "update") & F.col("changes").isNotNull()
    return events.select(
        "id",
        "timestamp",
        F.lit(source).alias("source"),
        "table_name",
        F.col("op").alias("operation"),
        F.coalesce(F.when(is_changed, merged), F.col("record")).alias("data"),
        "changes",
        "metadata",
        F.current_timestamp().alias("created_at"),
    )


def table_dir(name: Column) -> Column:
    """Folder name of a table; any name can be one, also none."""
    return F.coalesce(F.concat(F.lit("t"), F.lower(F.hex(F.encode(name, "UTF-8")))), F.lit("none"))


def event_log(
    log: DataFrame,
    since: Column | None = None,
    until: Column | None = None,
    source: str | None = None,
    table: str | None = None,
    operation: str | None = None,
    id: str | None = None,
) -> DataFrame:
    """Log rows of a half-open time range, source, table, operation and event id.

    On a stored log the range also filters the folders of its days, and the
    table that of the table; inside a day, files sorted by time and filters of
    ids skip row groups.
    """
    if "event_date" in log.columns:
        if since is not None:
            log = log.where(F.col("event_date") >= F.to_date(since))
        if until is not None:
            log = log.where(F.col("event_date") <= F.to_date(until))
        if table is not None:
            log = log.where(F.col("table_dir") == table_dir(F.lit(table)))
    if since is not None:
        log = log.where(F.col("timestamp") >= since)
    if until is not None:
        log = log.where(F.col("timestamp") < until)
    for name, wanted in (("source", source), ("table_name", table), ("operation", operation), ("id", id)):
        if wanted is not None:
            log = log.where(F.col(name) == wanted)
    return log
