"""Schema inference, drift detection and the schema catalog.

A catalog is ``(schema_name, table_name, column_name, data_type, ordinal,
last_updated)``. Inferred columns are ``(table_name, column_name, data_type,
is_key)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.functions.events import is_key_column
from rowtide.functions.frames import compute_once
from rowtide.functions.json_text import parse_object, parse_object_typed, text_of, type_tag
from rowtide.functions.values import SPARK_TYPES, cast_cell, fits_bigint, infer_type_code, storable, type_name

_COLUMN = ["table_name", "column_name"]
# Orders values after all non-null ones while the sequence order stays inside.
_NULLS_LAST = 2**62


def first_per_table(routed: DataFrame) -> DataFrame:
    """The first event of every table: the sample its schema is taken from."""
    # combines on the map side: one event per table and partition is shuffled
    named = routed.where(F.col("table_name").isNotNull())
    first = named.groupBy("table_name").agg(F.min_by(F.struct(*routed.columns), "seq").alias("first"))
    return first.select("first.*")


def event_cells(routed: DataFrame, changes: bool = True, raw: bool = True, room: bool = False) -> DataFrame:
    """One row per payload value, parsed once for several readers.

    Result ``table_name, seq, op, column_name, raw, type_code, is_null,
    is_change, overridden``: values of the record and, with ``changes``, those
    of an update's changes, which override record values of the same name. An
    event without values leaves one row without ``column_name``. Written once,
    the rows serve inference, drift, conflicts and casts.

    Without ``raw`` tokens stay out and a text is parsed once: a second time
    only where it may hold an integer beyond 64 signed bits, whose type hangs
    on its spelling. ``room`` appends ``no_room``: a number that no 64-bit
    integer column can hold.
    """
    texts = {"own": F.col("record")}
    if changes:
        texts["changed"] = F.when(F.col("op") == "update", F.col("changes"))
    spelled = F.lit(True) if raw else F.concat_ws(" ", *texts.values()).rlike("[0-9]{19}")
    parsed = compute_once(
        routed.where(F.col("table_name").isNotNull()),
        **{part: parse_object_typed(text) for part, text in texts.items()},
        **{f"{part}_raw": F.when(spelled, parse_object(text)) for part, text in texts.items()},
    )

    def entries(part: str) -> Column:
        names, size = F.map_keys(part), F.size(part)
        tokens = F.coalesce(F.map_values(f"{part}_raw"), F.array_repeat(F.lit(None).cast("string"), size))
        return F.arrays_zip(
            names.alias("name"),
            F.map_values(part).alias("value"),
            tokens.alias("raw"),
            F.array_repeat(F.lit(part == "changed"), size).alias("is_change"),
        )

    items = entries("own")
    if changes:
        # each side may be absent
        both = F.when(F.col("own").isNotNull() & F.col("changed").isNotNull(), F.concat(items, entries("changed")))
        items = F.coalesce(both, items, entries("changed"))
    changed_names = F.map_keys("changed") if changes else F.array().cast("array<string>")
    cell = parsed.select("table_name", "seq", "op", changed_names.alias("changed_names"), F.explode_outer(items).alias("cell"))
    tagged = cell.select(
        "table_name",
        "seq",
        "op",
        F.col("cell.name").alias("column_name"),
        "cell.value",
        "cell.raw",
        type_tag(F.col("cell.value")).alias("tag"),
        F.coalesce("cell.is_change", F.lit(False)).alias("is_change"),
        F.coalesce(F.array_contains("changed_names", F.col("cell.name")), F.lit(False)).alias("is_changed"),
    )
    token = F.col("raw") if raw else F.when(F.col("tag") == "STRING", text_of(F.col("value"))).otherwise(F.col("raw"))
    read = tagged.withColumn("token", token)
    return read.select(
        "table_name",
        "seq",
        "op",
        "column_name",
        *(["raw"] if raw else []),
        *([_no_room(F.col("tag"), F.col("value")).alias("no_room")] if room else []),
        infer_type_code(F.col("tag"), F.col("token")).alias("type_code"),
        (F.col("tag").isNull() | (F.col("tag") == "VOID")).alias("is_null"),
        "is_change",
        (F.col("is_changed") & ~F.col("is_change")).alias("overridden"),
    )


def _no_room(tag: Column, value: Column) -> Column:
    """As ``cast_raw`` to BIGINT: integers beyond 64 signed bits are decimals or doubles, both rounded."""
    fits = F.coalesce(fits_bigint(F.try_variant_get(value, "$", "double")), F.lit(False))
    return F.when(tag.startswith("DECIMAL") | tag.isin("DOUBLE", "FLOAT"), ~fits).otherwise(F.lit(False))


def cell_kinds(events: DataFrame) -> DataFrame:
    """The kinds of values of each column, with the first number of each; few rows, whatever the batch.

    ``table_name, column_name, type_code, is_null, no_room, is_delete, seq``,
    enough for ``infer_from_cells`` and ``conflicting_kinds``.
    """
    cells = event_cells(events, raw=False, room=True)
    values = cells.where(~F.col("overridden") & F.col("column_name").isNotNull())
    kind = [*_COLUMN, "type_code", "is_null", "no_room", (F.col("op") == "delete").alias("is_delete")]
    return values.groupBy(*kind).agg(F.min("seq").alias("seq"))


def _cells(events: DataFrame, changes: bool, raw: bool) -> DataFrame:
    return events if "overridden" in events.columns else event_cells(events, changes, raw)


def typed_cells(events: DataFrame, effective: bool = False, raw: bool = True) -> DataFrame:
    """One row per payload value: ``table_name, seq, op, column_name, raw, type_code, is_null``.

    ``events`` are routed ones or the rows of ``event_cells``. Only the record
    is looked at; ``effective`` adds the changes of updates, which override
    record values of the same name.
    """
    wanted = ~F.col("overridden") if effective else ~F.col("is_change")
    cells = _cells(events, effective, raw).where(wanted & F.col("column_name").isNotNull())
    return cells.drop("is_change", "overridden")


def infer_schema(events: DataFrame, scope: str = "batch") -> DataFrame:
    """Column types of every table seen, from routed events or the rows of ``event_cells``.

    ``scope="first"`` reads the first event per table, so later columns,
    columns that occur only in changes, and types behind a leading null go
    unseen. ``scope="batch"`` reads all events and the changes, and takes the
    first non-null value of each column.
    """
    if scope == "batch":
        return infer_from_cells(typed_cells(events, effective=True, raw=False))
    if scope != "first":
        raise ValueError(f"scope must be 'first' or 'batch', not {scope!r}")
    if "overridden" not in events.columns:
        return infer_from_cells(typed_cells(first_per_table(events), raw=False))
    own = F.when(~F.col("is_change") & F.col("column_name").isNotNull(), F.col("seq"))
    columns = events.groupBy(*_COLUMN).agg(
        F.min("seq").alias("any_seq"), F.min(own).alias("seq"), F.min_by("type_code", own).alias("type_code")
    )
    # the window sees the columns of one table
    first = F.min("any_seq").over(Window.partitionBy("table_name"))
    sample = columns.withColumn("first", first).where(F.col("seq") == F.col("first"))
    return sample.select(*_inferred())


def infer_from_cells(values: DataFrame) -> DataFrame:
    """Column types from typed cells: the first non-null value of each column decides."""
    order = F.when(F.col("is_null"), F.col("seq") + _NULLS_LAST).otherwise(F.col("seq"))
    inferred = values.groupBy(*_COLUMN).agg(F.min_by("type_code", order).alias("type_code"))
    return inferred.select(*_inferred())


def _inferred() -> list:
    data_type, is_key = type_name(F.col("type_code")), is_key_column(F.col("column_name"))
    return [*_COLUMN, data_type.alias("data_type"), is_key.alias("is_key")]


def missing_columns(inferred: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inferred columns that an existing table does not have."""
    known = inferred.join(catalog.select("table_name").distinct(), "table_name", "left_semi")
    return known.join(catalog.select(*_COLUMN), _COLUMN, "left_anti")


def new_tables(inferred: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inferred columns of tables that do not exist yet."""
    return inferred.join(catalog.select("table_name").distinct(), "table_name", "left_anti")


def evolve(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the columns a table lacks, as typed nulls."""
    added = {
        name: F.lit(None).cast(SPARK_TYPES[data_type])
        for name, data_type in columns.items()
        if name not in df.columns
    }
    return df.withColumns(added) if added else df


def as_catalog(columns: DataFrame, schema_name: str = "public", now: Column | None = None) -> DataFrame:
    """Catalog rows for ``(table_name, column_name, data_type)``; the key comes first."""
    # groups are the columns of one table
    place = Window.partitionBy("table_name").orderBy(
        is_key_column(F.col("column_name")).desc(), F.col("column_name")
    )
    return columns.select(
        F.lit(schema_name).alias("schema_name"),
        *_COLUMN,
        "data_type",
        F.row_number().over(place).alias("ordinal"),
        (F.current_timestamp() if now is None else now).alias("last_updated"),
    )


def refresh_catalog(
    catalog: DataFrame, columns: DataFrame, schema_name: str = "public", now: Column | None = None
) -> DataFrame:
    """Replace the rows of every table in ``columns`` by its current columns."""
    touched = columns.select("table_name").distinct().withColumn("schema_name", F.lit(schema_name))
    kept = catalog.join(touched, ["schema_name", "table_name"], "left_anti")
    return kept.select(*catalog.columns).unionByName(
        as_catalog(columns, schema_name, now).select(*catalog.columns)
    )


def extend_catalog(
    catalog: DataFrame, inferred: DataFrame, schema_name: str = "public", now: Column | None = None
) -> DataFrame:
    """Catalog after creating new tables and adding missing columns.

    Established types stay; rows of tables without a change are kept as they
    are. Both inputs are read once.
    """
    place = ["schema_name", *_COLUMN]
    known = catalog.select(*place, "data_type", "ordinal", "last_updated", F.lit(0).alias("is_new"))
    seen = inferred.select(
        F.lit(schema_name).alias("schema_name"), *_COLUMN, "data_type", F.lit(1).alias("is_new")
    )
    merged = (
        known.unionByName(seen, allowMissingColumns=True)
        .groupBy(*place)
        .agg(
            F.min_by("data_type", "is_new").alias("data_type"),
            F.max("ordinal").alias("ordinal"),
            F.max("last_updated").alias("last_updated"),
            F.min("is_new").alias("is_new"),
        )
    )
    # both windows see the columns of one table
    table = Window.partitionBy("schema_name", "table_name")
    ordinal = F.row_number().over(table.orderBy(is_key_column(F.col("column_name")).desc(), F.col("column_name")))
    stamp = F.current_timestamp() if now is None else now
    numbered = merged.withColumn("__changed", F.max("is_new").over(table) == 1).withColumn("__place", ordinal)
    return numbered.select(
        *place,
        "data_type",
        F.when(F.col("__changed"), F.col("__place")).otherwise(F.col("ordinal")).alias("ordinal"),
        F.when(F.col("__changed"), stamp).otherwise(F.col("last_updated")).alias("last_updated"),
    ).select(*catalog.columns)


def table_schema(catalog: DataFrame, table: str) -> DataFrame:
    """Columns of one table in order."""
    return (
        catalog.where(F.col("table_name") == table)
        .select("column_name", "data_type", "ordinal")
        .orderBy("ordinal")
    )


def table_exists(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Append ``exists`` to a list of table names."""
    known = catalog.select("table_name").distinct().withColumn("__known", F.lit(True))
    return names.join(known, "table_name", "left").select(
        *names.columns, F.coalesce("__known", F.lit(False)).alias("exists")
    )


def type_conflicts(routed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Values that cannot be stored in the established type of their column."""
    return conflicting_cells(typed_cells(routed, effective=True), catalog)


def conflicting_cells(values: DataFrame, catalog: DataFrame) -> DataFrame:
    joined = values.where(~F.col("is_null")).join(catalog.select(*_COLUMN, "data_type"), _COLUMN)
    value_type = type_name(F.col("type_code"))
    # An integer beyond 64 signed bits has an integer's type yet no room.
    overflow = (
        (F.col("data_type") == "BIGINT")
        & storable(F.col("data_type"), value_type)
        & cast_cell(F.col("raw"), F.col("data_type")).isNull()
    )
    return joined.where(~storable(F.col("data_type"), value_type) | overflow).select(
        "table_name",
        "seq",
        "column_name",
        F.col("data_type").alias("column_type"),
        value_type.alias("value_type"),
        "raw",
    )


def conflicting_kinds(kinds: DataFrame, catalog: DataFrame) -> DataFrame:
    """``seq`` of the first value of each kind that ``conflicting_cells`` would name."""
    joined = kinds.where(~F.col("is_null")).join(catalog.select(*_COLUMN, "data_type"), _COLUMN)
    fits = storable(F.col("data_type"), type_name(F.col("type_code")))
    overflow = (F.col("data_type") == "BIGINT") & fits & F.col("no_room")
    return joined.where(~fits | overflow).select("seq")


def cast_cells(routed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every stored value converted to its column's type, as text."""
    joined = typed_cells(routed, effective=True).join(catalog.select(*_COLUMN, "data_type"), _COLUMN)
    return joined.select(
        "table_name",
        "seq",
        "column_name",
        "data_type",
        cast_cell(F.col("raw"), F.col("data_type")).alias("stored"),
    )


def schema_violations(
    routed: DataFrame, catalog: DataFrame, auto_create: bool = True, auto_add: bool = True
) -> DataFrame:
    """Rows that fail because the policy forbids creating tables or adding columns.

    Result ``seq, table_name, violation``; the missing table is reported first.
    """
    tables = catalog.select("table_name").distinct()
    named = routed.where(F.col("table_name").isNotNull())
    found = None
    if not auto_create:
        found = named.join(tables, "table_name", "left_anti").select(
            "seq", "table_name", F.lit("missing_table").alias("violation")
        )
    if not auto_add:
        lacking = (
            typed_cells(named.where(F.col("op") != "delete"), effective=True, raw=False)
            .join(tables, "table_name", "left_semi")
            .join(catalog.select(*_COLUMN), _COLUMN, "left_anti")
            .groupBy("seq", "table_name")
            .agg(F.lit("missing_column").alias("violation"))
        )
        found = lacking if found is None else found.unionByName(lacking)
    if found is None:
        return named.where(F.lit(False)).select("seq", "table_name", F.lit("").alias("violation"))
    return found


def column_types(catalog: DataFrame, table: str) -> dict[str, str]:
    """Columns of one table as a dictionary; as long as the table is wide."""
    return {r["column_name"]: r["data_type"] for r in table_schema(catalog, table).collect()}
