"""Value types, conversion, schemas and the catalog."""

import json

import pytest
from pyspark.sql import functions as F

from rowtide.functions import text, values
from rowtide.operators import envelope, schema
from rowtide.plans.logs import TYPED_VALUES

EVENT = "seq bigint, record string, metadata string, action string, changes string"


def routed(spark, rows):
    """rows: (seq, table, record text, action, changes text)."""
    data = [(s, rec, json.dumps({"table_name": t}), action, chg) for s, t, rec, action, chg in rows]
    return envelope.with_route(spark.createDataFrame(data, EVENT))


def insert(seq, table, record, action="insert", changes=None):
    return (seq, table, record, action, changes)


def test_type_rules(spark):
    more = [
        ("9223372036854775807", "BIGINT"),
        ("9223372036854775808", "BIGINT"),
        ("-9223372036854775809", "DOUBLE"),
        ("0", "BIGINT"),
        ("-5", "BIGINT"),
        ("-1.5", "DOUBLE"),
        ("false", "BOOLEAN"),
        ('""', "TEXT"),
        ('"{}"', "JSONB"),
        ('"[]"', "JSONB"),
        ('"{\\"a\\":1} x"', "TEXT"),
        ('"[1] [2]"', "TEXT"),
        ('"12345678-1234-1234-1234-1234567890zz"', "TEXT"),
        ('"1"', "TEXT"),
        ('"true"', "TEXT"),
        ('"null"', "TEXT"),
        ("[]", "JSONB"),
        ("{}", "JSONB"),
    ]
    cases = TYPED_VALUES + more
    df = routed(spark, [insert(i, "t", f'{{"c":{v}}}') for i, (v, _) in enumerate(cases)])
    got = {
        r.seq: r.t
        for r in schema.typed_cells(df).select("seq", schema.type_name(F.col("type_code")).alias("t")).collect()
    }
    assert got == {i: t for i, (_, t) in enumerate(cases)}
    # one column per case: inference without tokens, and parsed once for several readers
    spread = routed(spark, [insert(i, "t", f'{{"c{i}":{v},"id":{i}}}') for i, (v, _) in enumerate(cases)])
    stored = schema.event_cells(spread, raw=False).cache()
    for events in (spread, stored):
        inferred = {r.column_name: r.data_type for r in schema.infer_schema(events).collect()}
        assert inferred == {f"c{i}": t for i, (_, t) in enumerate(cases)} | {"id": "BIGINT"}


def test_numbers_told_apart_by_spelling(spark):
    spelled = ["18446744073709551615", "18446744073709551615.0", "1.8446744073709551615e19", "9223372036854775808.0", "1.0", "1e0"]
    df = routed(spark, [insert(i, f"t{i}", f'{{"c":{v}}}') for i, v in enumerate(spelled)])
    got = {r.table_name: r.data_type for r in schema.infer_schema(df).collect()}
    tokens = {r.table_name: r.t for r in schema.typed_cells(df).select("table_name", schema.type_name(F.col("type_code")).alias("t")).collect()}
    assert got == tokens == {"t0": "BIGINT"} | {f"t{i}": "DOUBLE" for i in range(1, 6)}


def test_first_value_of_each_column_over_shapes(spark):
    rows = [
        insert(5, "t", '{"a":1,"b":null}'),
        insert(3, "t", '{"b":null,"a":"x"}'),
        insert(7, "t", '{"b":true,"c":1.5}'),
        insert(4, "t", '{"b":[1]}', "update", '{"b":"[1","d":null}'),
        insert(9, "t", '{"d":2}'),
        insert(1, "t", "{}"),
        insert(2, "t", "not json"),
        insert(6, "u", "{}"),
        (8, "t", None, "delete", None),
    ]
    got = {(r.table_name, r.column_name): r.data_type for r in schema.infer_schema(routed(spark, rows)).collect()}
    assert got == {("t", "a"): "TEXT", ("t", "b"): "TEXT", ("t", "c"): "DOUBLE", ("t", "d"): "BIGINT"}


@pytest.mark.parametrize(
    "column_type, raw, want",
    [
        ("TEXT", " a ", " a "),
        ("BOOLEAN", "true", "true"),
        ("BOOLEAN", "1", None),
        ("BIGINT", "12", "12"),
        ("BIGINT", "9223372036854775807", "9223372036854775807"),
        ("BIGINT", "2.5", "2"),
        ("BIGINT", "3.5", "4"),
        ("BIGINT", "9223372036854775808", None),
        ("BIGINT", "x", None),
        ("DOUBLE", "1", "1.0"),
        ("DOUBLE", "x", None),
        ("UUID", " 1B4E28BA-2FA1-11D2-883F-0016D3CCA427", "1b4e28ba-2fa1-11d2-883f-0016d3cca427"),
        ("UUID", "x", None),
        ("JSONB", " [1] ", "[1]"),
    ],
)
def test_cast(spark, column_type, raw, want):
    df = spark.createDataFrame([(raw, column_type)], "raw string, t string")
    row = df.select(
        values.cast_cell(F.col("raw"), F.col("t")).alias("by_data"),
        values.cast_raw(F.col("raw"), column_type).cast("string").alias("by_name"),
    ).first()
    assert row.by_data == want and row.by_name == want


def test_text_helpers(spark):
    df = spark.createDataFrame([(0,), (59,), (60,), (125,), (3600,), (7325,), (90000,)], "s bigint")
    got = [tuple(r) for r in df.select(text.format_uptime(F.col("s")), text.format_uptime_dashboard(F.col("s"))).collect()]
    assert got == [
        ("0s", "0h 0m"), ("59s", "0h 0m"), ("1m 0s", "0h 1m"), ("2m 5s", "0h 2m"),
        ("1h 0m", "1h 0m"), ("2h 2m", "2h 2m"), ("25h 0m", "25h 0m"),
    ]
    blank = spark.createDataFrame([("  \t1b4e28ba-2fa1-11d2-883f-0016d3cca427　",)], "t string")
    assert blank.select(text.is_uuid_text(F.col("t"))).first()[0]


def test_first_event_limits_and_their_repair(spark):
    df = routed(
        spark,
        [
            insert(1, "t", '{"id":1,"a":null}'),
            insert(2, "t", '{"id":1,"a":5,"late":true}'),
            insert(3, "t", '{"id":1}', "update", '{"changed":1.5}'),
            insert(0, "gone", '{"ID":"x"}', "delete"),
        ],
    )

    def columns(scope):
        return {(r.table_name, r.column_name): (r.data_type, r.is_key) for r in schema.infer_schema(df, scope).collect()}

    first = {("t", "id"): ("BIGINT", True), ("t", "a"): ("TEXT", False), ("gone", "ID"): ("TEXT", True)}
    assert columns("first") == first
    assert columns("batch") == {
        **first,
        ("t", "a"): ("BIGINT", False),
        ("t", "late"): ("BOOLEAN", False),
        ("t", "changed"): ("DOUBLE", False),
    }


def test_changes_override_record_values(spark):
    df = routed(spark, [insert(1, "t", '{"id":1,"a":"x"}', "update", '{"a":5}')])
    got = {r.column_name: r.data_type for r in schema.infer_schema(df).collect()}
    assert got == {"id": "BIGINT", "a": "BIGINT"}


def names(df):
    return sorted((r.table_name, r.column_name) for r in df.collect())


def test_catalog_steps(spark):
    then, now = F.timestamp_seconds(F.lit(1)), F.timestamp_seconds(F.lit(2))
    inferred = "table_name string, column_name string, data_type string, is_key boolean"
    old = spark.createDataFrame(
        [("t", "id", "BIGINT", True), ("t", "b", "TEXT", False), ("u", "x", "TEXT", False)], inferred
    )
    catalog = schema.as_catalog(old, now=then)
    seen = spark.createDataFrame(
        [("t", "id", "TEXT", True), ("t", "a", "DOUBLE", False), ("v", "id", "UUID", True), ("u", "x", "TEXT", False)],
        inferred,
    )
    assert names(schema.missing_columns(seen, catalog)) == [("t", "a")]
    assert names(schema.new_tables(seen, catalog)) == [("v", "id")]
    grown = schema.extend_catalog(catalog, seen, now=now)
    rows = {
        (r.table_name, r.column_name): (r.data_type, r.ordinal, r.sec)
        for r in grown.withColumn("sec", F.unix_seconds("last_updated")).collect()
    }
    assert rows == {
        ("t", "id"): ("BIGINT", 1, 2),
        ("t", "a"): ("DOUBLE", 2, 2),
        ("t", "b"): ("TEXT", 3, 2),
        ("u", "x"): ("TEXT", 1, 1),
        ("v", "id"): ("UUID", 1, 2),
    }
    assert schema.column_types(grown, "t") == {"id": "BIGINT", "a": "DOUBLE", "b": "TEXT"}
    refreshed = schema.refresh_catalog(grown, seen.where("table_name = 't'").drop("is_key"), now=now)
    assert names(refreshed) == [("t", "a"), ("t", "id"), ("u", "x"), ("v", "id")]
    asked = spark.createDataFrame([("t",), ("zz",)], "table_name string")
    assert {r.table_name: r.exists for r in schema.table_exists(asked, grown).collect()} == {"t": True, "zz": False}


def test_conflicts_and_overflow(spark):
    df = routed(
        spark,
        [
            insert(0, "t", '{"id":1,"n":1}'),
            insert(1, "t", '{"id":1,"n":2.5}'),
            insert(2, "t", '{"id":1,"n":"2"}'),
            insert(3, "t", '{"id":1,"n":null}'),
            insert(4, "t", '{"id":1,"n":18446744073709551615}'),
            insert(5, "t", '{"id":1}', "update", '{"n":true}'),
        ],
    )
    catalog = schema.as_catalog(schema.infer_schema(df, "first"))
    got = {r.seq: (r.column_type, r.value_type) for r in schema.type_conflicts(df, catalog).collect()}
    assert got == {2: ("BIGINT", "TEXT"), 4: ("BIGINT", "BIGINT"), 5: ("BIGINT", "BOOLEAN")}


def test_policy(spark):
    df = routed(
        spark,
        [
            insert(0, "t", '{"id":1,"a":1}'),
            insert(1, "t", '{"id":1,"b":1,"c":2}'),
            insert(2, "new", '{"id":1}'),
            insert(3, "t", '{"id":1,"z":1}', "delete"),
        ],
    )
    catalog = schema.as_catalog(schema.infer_schema(df.where("seq = 0")))

    def found(**policy):
        return {r.seq: r.violation for r in schema.schema_violations(df, catalog, **policy).collect()}

    assert found() == {}
    assert found(auto_create=False) == {2: "missing_table"}
    assert found(auto_add=False) == {1: "missing_column"}
    assert found(auto_create=False, auto_add=False) == {1: "missing_column", 2: "missing_table"}


def test_evolve(spark):
    grown = schema.evolve(spark.range(2), {"id": "BIGINT", "j": "JSONB", "f": "BOOLEAN"})
    assert grown.dtypes == [("id", "bigint"), ("j", "string"), ("f", "boolean")]
    assert grown.where("j is null and f is null").count() == 2


def test_kinds_name_the_conflicts_of_the_cells(spark):
    values = [
        "null", "true", "1", "-1", "1.5", "1.0", "1e2", "1e30", "-1e30", "1e400", "9223372036854775807", "9223372036854775808",
        "-9223372036854775808", "-9223372036854775809", "18446744073709551615", "18446744073709551616",
        "9223372036854775807.0", "0.10000000000000000000001", '"x"', '"18446744073709551615"', "[1]", '{"a":1}',
    ]
    rows = [(i, f"t{j}", "update", "insert", f'{{"id":{i},"c":{v}}}', None) for i, v in enumerate(values) for j in range(6)]
    rows.append((99, "t2", "update", "insert", '{"id":1,"c":2}', '{"c":1e40}'))
    events = spark.createDataFrame(rows, "seq bigint, table_name string, op string, action string, record string, changes string")
    kinds = schema.cell_kinds(events)
    cells = schema.typed_cells(events, effective=True)
    got = {tuple(r) for r in schema.infer_from_cells(kinds).collect()}
    assert got == {tuple(r) for r in schema.infer_from_cells(cells).collect()}
    catalog = spark.createDataFrame(
        [(f"t{j}", "c", name) for j, name in enumerate(["TEXT", "BOOLEAN", "BIGINT", "DOUBLE", "UUID", "JSONB"])],
        "table_name string, column_name string, data_type string",
    )
    wrong = schema.conflicting_cells(cells, catalog)
    for j in range(6):
        table = F.col("table_name") == f"t{j}"
        first = wrong.where(table).agg(F.min("seq")).first()[0]
        assert schema.conflicting_kinds(kinds.where(table), catalog).agg(F.min("seq")).first()[0] == first
    # in the integer column, each value by itself
    alone = schema.cell_kinds(events.where("table_name = 't2'").withColumn("table_name", F.concat(F.lit("s"), F.col("seq").cast("string"))))
    each = catalog.where("data_type = 'BIGINT'").crossJoin(events.select("seq").distinct()).select(
        F.concat(F.lit("s"), F.col("seq").cast("string")).alias("table_name"), "column_name", "data_type"
    )
    assert sorted(r.seq for r in schema.conflicting_kinds(alone, each).collect()) == sorted(
        {r.seq for r in wrong.where("table_name = 't2'").collect()}
    )
