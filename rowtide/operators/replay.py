"""Set-wise replay of change events into current table state.

Input rows are those of ``change_rows``: ``table_name, op, seq, payload, pk``.
State is ``(table_name, pk, row MAP<STRING,STRING>)``; a column absent from the
map was never written, a NULL value was written as null. Stored upsert state
also carries the sequence numbers of its writes (``versions``).

No step gathers one key's events in one place: upsert and the first live write
are combinable aggregates, and second writes of a live key are found in bounded
ranges of the sequence (see ``sequence``), so one key may hold any share of the
log.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.values import cast_raw
from rowtide.operators.sequence import RANGE_BITS, with_previous

POLICIES = ("upsert", "ignore", "replace")
STATE_COLUMNS = ["table_name", "pk", "row"]
_KEYS = ["table_name", "pk"]


def keyed_events(events: DataFrame) -> DataFrame:
    """Events that can take part in a keyed merge, reduced to what it reads."""
    usable = F.col("table_name").isNotNull() & F.col("pk").isNotNull() & F.col("payload").isNotNull()
    return events.where(usable).select("table_name", "pk", "seq", "op", "payload")


def effective_payload(events: DataFrame) -> DataFrame:
    return events.select("table_name", "pk", "seq", "op", "payload")


def cells(events: DataFrame) -> DataFrame:
    """One row per column present in a write: ``table_name, pk, seq, op, col, val``."""
    return keyed_events(events).where(F.col("op") != "delete").select(
        "table_name", "pk", "seq", "op", F.explode("payload").alias("col", "val")
    )


def replay(events: DataFrame, policy: str = "upsert") -> DataFrame:
    """Replay a whole log into state, in ``seq`` order."""
    if policy == "upsert":
        return _replay_upsert(events)
    if policy == "ignore":
        return _first_live(keyed_events(events))
    if policy == "replace":
        return _replay_replace(events)
    raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")


def _replay_upsert(events: DataFrame) -> DataFrame:
    return live_rows(versions(events))


VERSION_COLUMNS = [*STATE_COLUMNS, "at", "put_seq", "del_seq"]


def versions(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Upsert state with the sequence numbers it was written at.

    Appends to a state row ``at``, the number of each column's write,
    ``put_seq`` and ``del_seq``, the key's last write and delete. Keys that are
    deleted stay with an empty row, so that an older batch that comes later
    changes nothing newer. ``state`` rows, with or without these columns, go
    through the same aggregate as the events: one shuffle on the key.
    """
    # Every event yields a marker cell without a name; writes also yield one
    # cell per column. The latest write of a cell is live when it is later than
    # the key's last delete, so one combinable aggregate per cell is enough.
    marker = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    written = F.when(F.col("op") != "delete", F.map_entries("payload")).otherwise(
        F.array().cast("array<struct<key:string,value:string>>")
    )
    is_delete = F.col("op") == "delete"
    exploded = keyed_events(events).select(
        *_KEYS,
        F.when(is_delete, F.col("seq")).alias("del_seq"),
        F.when(~is_delete, F.col("seq")).alias("put_seq"),
        F.inline(F.concat(marker, written)).alias("col", "val"),
    )
    if state is not None:
        exploded = exploded.unionByName(_state_cells(state))
    latest = exploded.groupBy(*_KEYS, "col").agg(
        F.max("del_seq").alias("del_seq"),
        F.max("put_seq").alias("put_seq"),
        F.max_by("val", "put_seq").alias("val"),
    )
    # gathers at most one entry per column of the table
    gathered = latest.groupBy(*_KEYS).agg(
        F.max("del_seq").alias("del_seq"),
        F.max("put_seq").alias("put_seq"),
        F.collect_list(
            F.when(F.col("col").isNotNull(), F.struct("col", "val", F.col("put_seq").alias("at")))
        ).alias("entries"),
    )
    floor = F.coalesce(F.col("del_seq"), F.lit(-(2**62)))
    live = F.filter("entries", lambda e: e["at"] > floor)
    return gathered.withColumn("live", live).select(
        *_KEYS,
        F.map_from_entries(F.transform("live", lambda e: F.struct(e["col"], e["val"]))).alias("row"),
        F.map_from_entries(F.transform("live", lambda e: F.struct(e["col"], e["at"]))).alias("at"),
        "put_seq",
        "del_seq",
    )


def live_rows(versioned: DataFrame) -> DataFrame:
    """State rows whose key was written after its last delete; rows without numbers are live."""
    live = F.col("put_seq") > F.coalesce(F.col("del_seq"), F.lit(-(2**62)))
    return versioned.where(live | (F.col("put_seq").isNull() & F.col("del_seq").isNull())).select(*STATE_COLUMNS)


def _state_cells(state: DataFrame) -> DataFrame:
    """Cells of stored rows; without numbers of their own they precede every event."""
    if "at" not in state.columns:
        state = state.select(
            *STATE_COLUMNS,
            F.transform_values("row", lambda _, __: F.lit(-1).cast("bigint")).alias("at"),
            F.lit(-1).cast("bigint").alias("put_seq"),
            F.lit(None).cast("bigint").alias("del_seq"),
        )
    text = F.lit(None).cast("string")
    marker = F.array(F.struct(text.alias("key"), text.alias("value"), F.col("put_seq").alias("at"), F.col("del_seq").alias("del")))
    columns = F.transform(
        F.map_entries("row"),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.col("at")[e["key"]].alias("at"), F.lit(None).cast("bigint").alias("del")),
    )
    cells_ = state.where(F.col("pk").isNotNull()).select(*_KEYS, F.inline(F.concat(marker, columns)).alias("col", "val", "put_seq", "del_seq"))
    return cells_.select(*_KEYS, "del_seq", "put_seq", "col", "val")


def replay_upsert_wide(events: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Upsert replay when the columns are known: one aggregate, one shuffle.

    ``columns`` maps column name to column type (``TEXT``, ``BIGINT``, ...).
    Values are converted before the shuffle, so numbers travel as numbers.
    Result: ``table_name, pk`` and the typed columns.
    """
    put_seq = F.when(F.col("op") != "delete", F.col("seq"))
    narrow = keyed_events(events).select(
        *_KEYS,
        F.when(F.col("op") == "delete", F.col("seq")).alias("del_seq"),
        put_seq.alias("put_seq"),
        *[
            F.when(F.map_contains_key("payload", F.lit(name)), put_seq).alias(f"at_{i}")
            for i, name in enumerate(columns)
        ],
        *[
            cast_raw(F.col("payload")[name], data_type).alias(f"val_{i}")
            for i, (name, data_type) in enumerate(columns.items())
        ],
    )
    grouped = narrow.groupBy(*_KEYS).agg(
        F.max("del_seq").alias("del_seq"),
        F.max("put_seq").alias("put_seq"),
        *[F.max(f"at_{i}").alias(f"at_{i}") for i in range(len(columns))],
        *[F.max_by(f"val_{i}", f"at_{i}").alias(f"val_{i}") for i in range(len(columns))],
    )
    floor = F.coalesce(F.col("del_seq"), F.lit(-(2**62)))
    return grouped.where(F.col("put_seq") > floor).select(
        *_KEYS,
        *[F.when(F.col(f"at_{i}") > floor, F.col(f"val_{i}")).alias(name) for i, name in enumerate(columns)],
    )


def _first_live(rows: DataFrame) -> DataFrame:
    """Payload of the first write after the last delete of each key.

    The last delete is a combinable maximum, joined back as one number a key;
    the first write above it is a combinable minimum. The join is a plain one,
    so a key with a large share of the rows is split at run time.
    """
    is_delete = F.col("op") == "delete"
    floors = rows.where(is_delete).groupBy(*_KEYS).agg(F.max("seq").alias("__floor"))
    live = rows.where(~is_delete).join(floors, _KEYS, "left").where(F.col("__floor").isNull() | (F.col("seq") > F.col("__floor")))
    return live.groupBy(*_KEYS).agg(F.min_by("payload", "seq").alias("row"))


def _replay_replace(events: DataFrame) -> DataFrame:
    """Plain inserts: first live row per key, and every row of tables without key.

    Second live rows of a key are errors, listed by ``key_violations``.
    """
    keyed = _first_live(keyed_events(events))
    keyed_tables = events.where(F.col("key_name").isNotNull()).select("table_name").distinct()
    appended = (
        events.where(
            F.col("key_name").isNull()
            & F.col("table_name").isNotNull()
            & F.col("payload").isNotNull()
            & (F.col("op") != "delete")
        )
        .join(keyed_tables, "table_name", "left_anti")
        .select("table_name", "pk", F.col("payload").alias("row"))
    )
    return keyed.unionByName(appended)


def as_events(state: DataFrame) -> DataFrame:
    """State rows as snapshots that precede every event of a batch."""
    return state.where(F.col("pk").isNotNull()).select(
        "table_name",
        "pk",
        F.lit(-1).cast("bigint").alias("seq"),
        F.lit("snapshot").alias("op"),
        F.col("row").alias("payload"),
        F.lit("id").alias("key_name"),
    )


def key_violations(events: DataFrame, state: DataFrame | None = None, bits: int = RANGE_BITS) -> DataFrame:
    """Under ``replace``: writes whose key was live already."""
    rows = keyed_events(events).select(*_KEYS, "seq", "op")
    if state is not None:
        held = as_events(state).join(rows.select(*_KEYS).distinct(), _KEYS, "left_semi")
        rows = rows.unionByName(held.select(*_KEYS, "seq", "op"))
    marked = with_previous(rows, "op", _KEYS, "previous_op", bits=bits)
    return marked.where(
        (F.col("op") != "delete") & (F.col("previous_op") != "delete") & (F.col("seq") >= 0)
    ).select(*_KEYS, "seq", "op")


def apply_batch(state: DataFrame, events: DataFrame, policy: str = "upsert") -> DataFrame:
    """New state from stored state and a later batch; untouched rows pass by.

    Upsert takes state and batch through one aggregate. Given state with
    ``versions`` columns it returns them as well, and the batch may be an
    older one that was held back: what is newer stays.
    """
    if policy == "upsert":
        numbered = "at" in state.columns
        merged = versions(events, state)
        keyless = state.where(F.col("pk").isNull())
        columns = VERSION_COLUMNS if numbered else STATE_COLUMNS
        return (merged if numbered else live_rows(merged)).select(*columns).unionByName(keyless.select(*columns))
    touched_keys = events.where(F.col("pk").isNotNull()).select(*_KEYS).distinct()
    untouched = state.join(touched_keys, _KEYS, "left_anti")
    touched = as_events(state.join(touched_keys, _KEYS, "left_semi"))
    batch = events.select("table_name", "pk", "seq", "op", "payload", "key_name")
    replayed = replay(touched.unionByName(batch), policy)
    return untouched.select(*STATE_COLUMNS).unionByName(replayed.select(*STATE_COLUMNS))


def to_table(state: DataFrame, table: str, columns: Mapping[str, str]) -> DataFrame:
    """Typed projection of one table's state by its catalog columns."""
    return state.where(F.col("table_name") == table).select(
        *[cast_raw(F.col("row")[name], data_type).alias(name) for name, data_type in columns.items()]
    )


def skipped_deletes(events: DataFrame) -> DataFrame:
    """Deletes without a key column: skipped with a warning, not an error."""
    return events.where(
        (F.col("op") == "delete")
        & F.col("table_name").isNotNull()
        & F.col("payload").isNotNull()
        & F.col("key_name").isNull()
    )


# Reasons a row fails its batch, in order of the checks.
VIOLATIONS = [
    "missing_table_name",
    "bad_record",
    "missing_key",
    "null_key",
    "empty_update",
    "missing_table",
    "missing_column",
    "type_conflict",
    "duplicate_key",
]


def violation(policy: str = "upsert") -> Column:
    """Reason why a row cannot be written, NULL when it can."""
    writes = F.col("op") != "delete"
    reason = F.when(F.col("table_name").isNull(), F.lit("missing_table_name")).when(
        F.col("payload").isNull(), F.lit("bad_record")
    )
    if policy in ("upsert", "ignore"):
        reason = reason.when(writes & F.col("key_name").isNull(), F.lit("missing_key"))
    else:
        reason = reason.when(writes & (F.size("payload") == 0), F.lit("missing_key"))
    reason = reason.when(
        writes & F.col("key_name").isNotNull() & F.col("pk").isNull(), F.lit("null_key")
    )
    if policy == "upsert":
        reason = reason.when(writes & (F.size("payload") == 1), F.lit("empty_update"))
    return reason


def with_violation(events: DataFrame, policy: str = "upsert") -> DataFrame:
    return events.withColumn("violation", violation(policy))


def row_violations(events: DataFrame, policy: str = "upsert") -> DataFrame:
    return with_violation(events, policy).where(F.col("violation").isNotNull())
