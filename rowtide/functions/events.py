"""Fields of a change event."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowtide.functions.json_text import string_only

# The operations; any other action counts as a snapshot.
OPERATIONS = ["insert", "update", "delete"]

# Every spelling whose lower case is "id", in order of preference.
KEY_SPELLINGS = ["id", "Id", "ID", "iD"]
# Deletes look only under the first two.
DELETE_KEY_SPELLINGS = ["id", "Id"]


def operation(action: Column) -> Column:
    lowered = F.lower(action)
    return F.when(lowered.isin(OPERATIONS), lowered).otherwise(F.lit("snapshot"))


def string_field(metadata: Column, name: str) -> Column:
    """A metadata value when it is a JSON string, otherwise NULL."""
    return string_only(metadata[name])


def table_name(metadata: Column) -> Column:
    return string_field(metadata, "table_name")


def database_name(metadata: Column) -> Column:
    return string_field(metadata, "database_name")


def merge_changes(op: Column, record: Column, changes: Column) -> Column:
    """Effective payload: for updates the changed fields override the record."""
    kept = F.map_filter(record, lambda name, _: ~F.map_contains_key(changes, name))
    merged = F.map_concat(kept, changes)
    return F.when((op == "update") & changes.isNotNull(), merged).otherwise(record)


def key_name(op: Column, payload: Column) -> Column:
    """Name of the key column in a payload, NULL when there is none."""
    def first_present(names):
        chosen = F.lit(None).cast("string")
        for name in reversed(names):
            chosen = F.when(F.map_contains_key(payload, name), F.lit(name)).otherwise(chosen)
        return chosen

    return F.when(op == "delete", first_present(DELETE_KEY_SPELLINGS)).otherwise(
        first_present(KEY_SPELLINGS)
    )


def is_key_column(name: Column) -> Column:
    return F.lower(name) == "id"


def derived_id(source: Column, seq: Column) -> Column:
    """Repeatable id of an event that carries none, in UUID form; NULL without a number."""
    digest = F.sha2(F.concat(source, F.lit("|"), seq.cast("string")), 256)
    return F.regexp_replace(
        F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
