"""Decoding of change messages and field-map entries into change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtide.functions import events as ev
from rowtide.functions.frames import compute_once
from rowtide.functions.json_text import envelope_object, parse_object, parse_object_typed, text_of, type_tag
from rowtide.functions.text import canonical_uuid, is_uuid_any_spelling, lossy_utf8
from rowtide.functions.values import canonical_key

# The envelope's fields.
REQUIRED_FIELDS = ["record", "metadata", "action"]
ENVELOPE_FIELDS = ["id", "timestamp", *REQUIRED_FIELDS, "changes"]

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def decode_envelope(
    df: DataFrame,
    seq: str = "seq",
    value: str = "value",
    source: str = "stream",
    now: Column | None = None,
) -> DataFrame:
    """One JSON message per row -> event columns plus ``reject_reason``.

    ``reject_reason`` is NULL for a good message. ``id`` and ``timestamp`` are
    filled in only when absent; a present but unusable one rejects the message.
    The message text stays in ``payload``.
    """
    raw = F.col(value)
    is_binary = isinstance(df.schema[value].dataType, T.BinaryType)
    text = raw.cast("string")
    readable = F.is_valid_utf8(text) if is_binary else F.lit(True)
    payload = lossy_utf8(raw) if is_binary else text
    message = envelope_object(F.when(readable, text) if is_binary else text)

    parsed = compute_once(df.withColumn("payload", payload), message=message)
    message = F.col("message")
    reason = F.coalesce(_reject_reason(message), _missing_seq(seq))
    if is_binary:
        reason = F.when(~readable, F.lit("invalid_utf8")).otherwise(reason)
    given_id = canonical_uuid(text_of(message["id"]))
    given_time = text_of(message["timestamp"]).try_cast("timestamp")
    return parsed.select(
        F.col(seq).cast("bigint").alias("seq"),
        F.coalesce(given_id, ev.derived_id(F.lit(source), F.col(seq))).alias("id"),
        F.coalesce(given_time, F.current_timestamp() if now is None else now).alias("timestamp"),
        *[text_of(message[name]).alias(name) for name in [*REQUIRED_FIELDS, "changes"]],
        "payload",
        reason.alias("reject_reason"),
    )


def _missing_seq(seq: str) -> Column:
    """Without its place in the order a message could not be replayed."""
    return F.when(F.col(seq).cast("bigint").isNull(), F.lit("missing_seq"))


def _reject_reason(message: Column) -> Column:
    def tag(name):
        return type_tag(message[name])

    def has(name):
        return F.map_contains_key(message, name)

    own_names = F.filter(F.map_keys(message), lambda k: k.isin(ENVELOPE_FIELDS))
    usable_id = (tag("id") == "STRING") & is_uuid_any_spelling(text_of(message["id"]))
    instant = text_of(message["timestamp"])
    usable_time = (
        (tag("timestamp") == "STRING") & instant.rlike(RFC3339) & instant.try_cast("timestamp").isNotNull()
    )
    reason = (
        F.when(message.isNull(), F.lit("not_an_object"))
        .when(F.size(F.array_distinct(own_names)) < F.size(own_names), F.lit("duplicate_field"))
        .when(has("id") & ~usable_id, F.lit("bad_id"))
        .when(has("timestamp") & ~usable_time, F.lit("bad_timestamp"))
    )
    for name in REQUIRED_FIELDS:
        reason = reason.when(~has(name), F.lit(f"missing_{name}")).when(
            tag(name) != "STRING", F.lit(f"bad_{name}")
        )
    return reason.when(has("changes") & ~tag("changes").isin("STRING", "VOID"), F.lit("bad_changes"))


def decode_entries(
    df: DataFrame,
    seq: str = "seq",
    fields: str = "fields",
    entry_id: str = "entry_id",
    source: str = "entries",
    now: Column | None = None,
) -> DataFrame:
    """Name -> bytes entries to event columns plus ``reject_reason``.

    The first required field that is missing or not UTF-8 names the reason;
    unusable ``changes`` count as absent.
    """
    def text(name):
        value = F.col(fields)[name].cast("string")
        return F.when(F.is_valid_utf8(value), value)

    reason = _missing_seq(seq)
    for name in reversed(REQUIRED_FIELDS):
        reason = F.when(text(name).isNull(), F.lit(f"missing_{name}")).otherwise(reason)
    shown = F.transform_values(F.col(fields), lambda _, v: lossy_utf8(v))
    return df.select(
        F.col(seq).cast("bigint").alias("seq"),
        F.coalesce(ev.derived_id(F.lit(source), F.col(entry_id)), ev.derived_id(F.lit(source + " seq"), F.col(seq))).alias("id"),
        (F.current_timestamp() if now is None else now).alias("timestamp"),
        *[text(name).alias(name) for name in [*REQUIRED_FIELDS, "changes"]],
        F.to_json(shown).alias("payload"),
        reason.alias("reject_reason"),
    )


def split_rejects(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and rejects as ``(seq, reason, payload, error)``."""
    good = decoded.where(F.col("reject_reason").isNull()).drop("reject_reason", "payload")
    rejects = decoded.where(F.col("reject_reason").isNotNull()).select(
        "seq",
        F.col("reject_reason").alias("reason"),
        "payload",
        F.concat(
            F.lit("cannot decode message: "), F.col("reject_reason"), F.lit(". Payload: "), F.col("payload")
        ).alias("error"),
    )
    return good, rejects


def make_events(
    df: DataFrame,
    record: Column,
    metadata: Column,
    action: Column,
    changes: Column | None = None,
    seq: str | None = "seq",
    source: str = "made",
) -> DataFrame:
    """Events from the four texts with a fresh id and the current instant.

    With ``seq`` the id is derived from it, so that a re-run agrees; without,
    it is random.
    """
    fresh = F.uuid() if seq is None else ev.derived_id(F.lit(source), F.col(seq))
    order = [] if seq is None else [F.col(seq).cast("bigint").alias("seq")]
    return df.select(
        *order,
        fresh.alias("id"),
        F.current_timestamp().alias("timestamp"),
        record.cast("string").alias("record"),
        metadata.cast("string").alias("metadata"),
        action.cast("string").alias("action"),
        (F.lit(None) if changes is None else changes).cast("string").alias("changes"),
    )


def with_route(events: DataFrame) -> DataFrame:
    """Append ``table_name``, ``database_name`` (NULL unless strings) and ``op``."""
    parsed = compute_once(events, __metadata=parse_object_typed(F.col("metadata")))
    metadata = F.col("__metadata")
    return parsed.select(
        *events.columns,
        ev.operation(F.col("action")).alias("op"),
        ev.table_name(metadata).alias("table_name"),
        ev.database_name(metadata).alias("database_name"),
    )


def with_payload(routed: DataFrame) -> DataFrame:
    """Append the effective ``payload``, ``changes_ok``, ``key_name`` and ``pk``.

    ``payload`` is NULL when the record is not an object. Changes that are not
    an object are ignored and flagged.
    """
    op = F.col("op")
    parsed = compute_once(
        routed,
        record_map=parse_object(F.col("record")),
        changes_map=F.when(op == "update", parse_object(F.col("changes"))),
    )
    changes_ok = (op != "update") | F.col("changes").isNull() | F.col("changes_map").isNotNull()

    merged = compute_once(
        parsed, payload=ev.merge_changes(op, F.col("record_map"), F.col("changes_map"))
    )
    named = merged.withColumn("key_name", ev.key_name(op, F.col("payload")))
    return named.select(
        *routed.columns,
        changes_ok.alias("changes_ok"),
        "payload",
        "key_name",
        canonical_key(F.col("payload")[F.col("key_name")], _is_number(F.col("key_name"))).alias("pk"),
    )


def _is_number(name: Column) -> Column:
    """Whether the effective key is a JSON number; parsed again only for keys whose spelling asks for it."""
    changed = F.when(F.col("op") == "update", parse_object_typed(F.col("changes"))[name])
    return type_tag(F.coalesce(changed, parse_object_typed(F.col("record"))[name])) != "STRING"


def change_rows(good: DataFrame) -> DataFrame:
    """Decoded events -> routed events with effective payload and key."""
    return with_payload(with_route(good))


def operation_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("table_name", "op").agg(F.count("*").alias("n"))


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def touched_tables(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("table_name").isNotNull()).select("table_name").distinct()
