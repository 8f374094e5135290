"""Type inference, schemas, drift and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import envelope, schema
from rowtide.operators.replay import replay_upsert_wide
from rowtide.plans import logs
from rowtide.plans.registry import DRIFT, LOG, UPSERT, query
from rowtide.session import materialize

_KINDS = len(logs.TYPED_VALUES)
_KIND_TYPE = "CASE event_id % 18 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(logs.TYPED_VALUES)
) + " END"

# Columns of the first event, as written by the change log.
_FIRST = """first_event AS (SELECT * FROM log WHERE seq = (SELECT min(seq) FROM log))
, first_columns AS (
  SELECT 'id' AS column_name, 'BIGINT' AS data_type, TRUE AS is_key FROM first_event
  UNION ALL SELECT 'event_type', 'TEXT', FALSE FROM first_event
  UNION ALL SELECT 'value', 'DOUBLE', FALSE FROM first_event WHERE val IS NOT NULL)
, batch_columns AS (
  SELECT 'id' AS column_name, 'BIGINT' AS data_type, TRUE AS is_key
  UNION ALL SELECT 'event_type', 'TEXT', FALSE
  UNION ALL SELECT 'value', 'DOUBLE', FALSE WHERE EXISTS (SELECT 1 FROM log WHERE val IS NOT NULL)
  UNION ALL SELECT 'k', 'BIGINT', FALSE WHERE EXISTS (SELECT 1 FROM log WHERE k IS NOT NULL)
  UNION ALL SELECT 'extra', 'BIGINT', FALSE WHERE EXISTS (SELECT 1 FROM drift WHERE extra IS NOT NULL))
"""


def _routed(log):
    return envelope.with_route(logs.good_events(log))


def _stored(log):
    """Routed events for several readers."""
    events = _routed(log).select("seq", "table_name", "op", "record", "changes")
    return materialize(events, "routed")


def _stored_cells(log, raw=True):
    """Parsed values of a log's events for several readers."""
    return materialize(schema.event_cells(_routed(log), raw=raw), "cells")


def _stored_catalog(inferred):
    return materialize(schema.as_catalog(inferred), "catalog")


@query(
    f"""SELECT event_id AS seq, 'cell' AS column_name, {_KIND_TYPE} AS data_type FROM events
UNION ALL SELECT event_id, 'id', 'BIGINT' FROM events"""
)
def infer_types(spark, sf_dir):
    values = schema.typed_cells(_routed(logs.typed_log(spark, sf_dir)))
    return values.select("seq", "column_name", schema.type_name(F.col("type_code")).alias("data_type"))


@query(
    f"""SELECT DISTINCT 'kind_' || (event_id % 18) AS table_name, 'cell' AS column_name, {_KIND_TYPE} AS data_type,
  FALSE AS is_key FROM events
UNION ALL SELECT DISTINCT 'kind_' || (event_id % 18), 'id', 'BIGINT', TRUE FROM events"""
)
def infer_schema_kinds(spark, sf_dir):
    return schema.infer_schema(_routed(logs.typed_log(spark, sf_dir)))


@query(f"WITH {DRIFT}, {_FIRST} SELECT 'users' AS table_name, * FROM first_columns")
def infer_schema_first(spark, sf_dir):
    return schema.infer_schema(_routed(logs.drift_log(spark, sf_dir)), scope="first")


@query(f"WITH {DRIFT}, {_FIRST} SELECT 'users' AS table_name, * FROM batch_columns")
def infer_schema_batch(spark, sf_dir):
    return schema.infer_schema(_routed(logs.drift_log(spark, sf_dir)))


@query(
    f"""WITH {LOG}
SELECT 'users_' || (user_id % 3) AS table_name, min(seq) AS seq,
  arg_min(user_id, seq) AS rec_id, arg_min(event_type, seq) AS rec_type FROM log GROUP BY 1"""
)
def first_per_table(spark, sf_dir):
    first = schema.first_per_table(_routed(logs.multi_table_log(spark, sf_dir)))
    return first.select(
        "table_name",
        "seq",
        F.get_json_object("record", "$.id").cast("bigint").alias("rec_id"),
        F.get_json_object("record", "$.event_type").alias("rec_type"),
    )


@query(
    f"""WITH {DRIFT}, {_FIRST}
SELECT 'users' AS table_name, column_name, data_type, is_key FROM batch_columns b
WHERE NOT EXISTS (SELECT 1 FROM first_columns f WHERE f.column_name = b.column_name)"""
)
def missing_columns(spark, sf_dir):
    cells = _stored_cells(logs.drift_log(spark, sf_dir), raw=False)
    catalog = _stored_catalog(schema.infer_schema(cells, scope="first"))
    return schema.missing_columns(schema.infer_schema(cells), catalog)


@query(UPSERT + "SELECT id, event_type, value, k, CAST(NULL AS BIGINT) AS extra, CAST(NULL AS BOOLEAN) AS flagged FROM final")
def evolved_table(spark, sf_dir):
    events = logs.changes(logs.change_log(spark, sf_dir))
    users = replay_upsert_wide(events, logs.USERS_COLUMNS).drop("table_name", "pk")
    return schema.evolve(users, {"k": "BIGINT", "extra": "BIGINT", "flagged": "BOOLEAN"})


@query(
    f"""WITH {DRIFT}, {_FIRST}
, grown AS (SELECT 'users' AS table_name, column_name, data_type, is_key FROM batch_columns)
, kinds AS (
  SELECT DISTINCT 'kind_' || (event_id % 18) AS table_name, 'cell' AS column_name, {_KIND_TYPE} AS data_type, FALSE AS is_key FROM events
  UNION ALL SELECT DISTINCT 'kind_' || (event_id % 18), 'id', 'BIGINT', TRUE FROM events)
SELECT table_name, column_name, data_type,
  CAST(row_number() OVER (PARTITION BY table_name ORDER BY is_key DESC, column_name) AS INTEGER) AS ordinal
FROM (SELECT * FROM grown UNION ALL SELECT * FROM kinds)"""
)
def extend_catalog(spark, sf_dir):
    drift = _stored_cells(logs.drift_log(spark, sf_dir), raw=False)
    kinds = schema.infer_schema(_routed(logs.typed_log(spark, sf_dir)))
    before = _stored_catalog(schema.infer_schema(drift, scope="first").unionByName(kinds))
    after = schema.extend_catalog(before, schema.infer_schema(drift))
    return after.select("table_name", "column_name", "data_type", "ordinal")


@query(
    f"""WITH {LOG}
, tables AS (SELECT DISTINCT 'users_' || (user_id % 3) AS table_name FROM events)
, stale AS (SELECT table_name, 'id' AS column_name, 'TEXT' AS data_type, 1 AS ordinal FROM tables
  UNION ALL SELECT table_name, 'gone', 'TEXT', 2 FROM tables
  UNION ALL SELECT 'other', 'id', 'BIGINT', 1)
, columns AS (
  SELECT DISTINCT 'users_' || (user_id % 3) AS table_name, 'id' AS column_name, 'BIGINT' AS data_type, 1 AS ordinal FROM log
  UNION ALL SELECT DISTINCT 'users_' || (user_id % 3), 'event_type', 'TEXT', 2 FROM log
  UNION ALL SELECT DISTINCT 'users_' || (user_id % 3), 'k', 'BIGINT', 3 FROM log WHERE k IS NOT NULL
  UNION ALL SELECT DISTINCT 'users_' || (user_id % 3), 'value', 'DOUBLE', 4 FROM log WHERE val IS NOT NULL)
SELECT * FROM columns UNION ALL SELECT * FROM stale WHERE table_name = 'other'"""
)
def refresh_catalog(spark, sf_dir):
    target = F.concat(F.lit("users_"), (F.col("user_id") % 3).cast("string"))
    tables = logs.table(spark, sf_dir, "events").select(target.alias("table_name")).distinct()
    names = F.array(F.lit("id"), F.lit("gone"))
    stale = tables.select("table_name", F.explode(names).alias("column_name"), F.lit("TEXT").alias("data_type"))
    other = spark.createDataFrame([("other", "id", "BIGINT")], "table_name string, column_name string, data_type string")
    before = schema.as_catalog(stale.unionByName(other))
    current = schema.infer_schema(_routed(logs.multi_table_log(spark, sf_dir)))
    after = schema.refresh_catalog(before, current.drop("is_key"))
    return after.select("table_name", "column_name", "data_type", "ordinal")


@query(
    f"""WITH {DRIFT}, {_FIRST}
SELECT column_name, data_type,
  CAST(row_number() OVER (ORDER BY is_key DESC, column_name) AS INTEGER) AS ordinal FROM batch_columns"""
)
def table_schema(spark, sf_dir):
    catalog = schema.as_catalog(schema.infer_schema(_routed(logs.drift_log(spark, sf_dir))))
    return schema.table_schema(catalog, "users")


@query("SELECT DISTINCT 'users_' || (user_id % 5) AS table_name, user_id % 5 < 3 AS \"exists\" FROM events")
def table_exists(spark, sf_dir):
    catalog = _stored_catalog(schema.infer_schema(_routed(logs.multi_table_log(spark, sf_dir)), scope="first"))
    wanted = F.concat(F.lit("users_"), (F.col("user_id") % 5).cast("string")).alias("table_name")
    names = logs.table(spark, sf_dir, "events").select(wanted).distinct()
    return schema.table_exists(names, catalog)


@query(
    f"""WITH {LOG}
, routed AS (SELECT *, 'users_' || (user_id % 3) AS table_name FROM log)
, sample AS (SELECT table_name, min(seq) AS seq FROM routed GROUP BY table_name)
, has_value AS (SELECT r.table_name FROM routed r JOIN sample USING (table_name, seq) WHERE val IS NOT NULL)
SELECT seq, table_name, 'missing_table' AS violation FROM routed WHERE table_name = 'users_0'
UNION ALL
SELECT seq, table_name, 'missing_column' FROM routed
WHERE table_name <> 'users_0' AND op <> 'delete'
  AND (k IS NOT NULL OR (val IS NOT NULL AND table_name NOT IN (SELECT table_name FROM has_value)))"""
)
def schema_policy(spark, sf_dir):
    routed = _stored(logs.multi_table_log(spark, sf_dir))
    first = schema.infer_schema(routed, scope="first")
    catalog = _stored_catalog(first.where(F.col("table_name") != "users_0"))
    return schema.schema_violations(routed, catalog, auto_create=False, auto_add=False)


_MIXED = f"""mixed AS (
  SELECT event_id AS seq, event_id % 6 AS t, event_id % 18 AS rule, {_KIND_TYPE} AS value_type,
    CASE event_id % 6 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'BOOLEAN' WHEN 2 THEN 'BIGINT' ELSE 'DOUBLE' END AS column_type
  FROM events)"""


@query(
    f"""WITH {_MIXED}
SELECT 'kind_' || t AS table_name, seq, 'cell' AS column_name, column_type, value_type FROM mixed
WHERE rule IN (7, 8, 9, 10, 11, 13, 14, 15, 16, 17)
  AND NOT (column_type = 'BIGINT' AND value_type = 'BIGINT')"""
)
def type_conflicts(spark, sf_dir):
    cells = _stored_cells(logs.typed_log(spark, sf_dir, tables=6))
    catalog = _stored_catalog(schema.infer_schema(cells, scope="first"))
    return schema.type_conflicts(cells, catalog).drop("raw")


@query(
    f"""WITH {_MIXED}
SELECT 'kind_' || t AS table_name, seq, 'cell' AS column_name, column_type AS data_type,
  CASE rule WHEN 1 THEN 'true' WHEN 2 THEN '1' WHEN 3 THEN '1.5' WHEN 4 THEN '1.0' WHEN 5 THEN '100.0'
    WHEN 6 THEN '18446744073709551615' WHEN 8 THEN '-9223372036854775808' WHEN 12 THEN '{{"a":1}}' END AS stored
FROM mixed
UNION ALL SELECT 'kind_' || t, seq, 'id', 'BIGINT', CAST(seq AS VARCHAR) FROM mixed"""
)
def cast_cells(spark, sf_dir):
    cells = _stored_cells(logs.typed_log(spark, sf_dir, tables=6))
    catalog = _stored_catalog(schema.infer_schema(cells, scope="first"))
    return schema.cast_cells(cells, catalog)


# Columns of three tables as payloads; part of the oracles below.
_REAL = {
    "orders": ("o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]),
    "part": ("p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "documents": ("doc_id", ["text", "lang", "source", "n_chars"]),
}
_REAL_NUMBERS = {"o_custkey": "BIGINT", "o_totalprice": "DOUBLE", "p_size": "BIGINT", "p_retailprice": "DOUBLE", "n_chars": "BIGINT"}


def _real_log(spark, sf_dir):
    """One insert for each row of the three tables; rows of a table are numbered by their key."""
    log = None
    for name, (key, columns) in _REAL.items():
        record = F.to_json(F.struct(F.col(key).alias("id"), *columns))
        value = logs.message(record, logs.metadata_text(F.lit(name)), F.lit("insert"), F.lit(None).cast("string"))
        part = logs.table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("seq"), value.alias("value"))
        log = part if log is None else log.unionByName(part)
    return log


_REAL_CELLS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, CAST({key} AS BIGINT) AS seq, '{c}' AS column_name, '{_REAL_NUMBERS.get(c, 'TEXT')}' AS data_type, "
    + (f"CAST({c} AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt" if c in _REAL_NUMBERS else f"CAST(NULL AS DOUBLE) AS num, {c} AS txt")
    + f" FROM {name} WHERE {c} IS NOT NULL"
    for name, (key, columns) in _REAL.items()
    for c in columns
)


@query(f"SELECT table_name, column_name, data_type, count(*) AS n FROM ({_REAL_CELLS}) GROUP BY ALL")
def infer_real_columns(spark, sf_dir):
    """Types of whole tables' columns, and how many values they are inferred from."""
    stored = _stored_cells(_real_log(spark, sf_dir))
    inferred = schema.infer_schema(stored, scope="batch").where(F.col("column_name") != "id")
    cells = schema.typed_cells(stored, effective=True).where("NOT is_null").groupBy("table_name", "column_name")
    counts = cells.agg(F.count("*").alias("n"))
    return inferred.join(counts, ["table_name", "column_name"]).select("table_name", "column_name", "data_type", "n")


@query(_REAL_CELLS)
def cast_real_cells(spark, sf_dir):
    """Every value of whole tables through its inferred column's type."""
    cells = _stored_cells(_real_log(spark, sf_dir))
    catalog = _stored_catalog(schema.infer_schema(cells, scope="batch"))
    stored = schema.cast_cells(cells, catalog).where((F.col("column_name") != "id") & F.col("stored").isNotNull())
    is_text = F.col("data_type") == "TEXT"
    return stored.select(
        "table_name", "seq", "column_name", "data_type",
        F.when(~is_text, F.col("stored").cast("double")).alias("num"), F.when(is_text, F.col("stored")).alias("txt"),
    )
