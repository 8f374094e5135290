"""Set-wise replay against the sequential replayer."""

import random

import pytest
from pyspark.sql import functions as F

from rowtide.operators import replay
from tests import sequential

SCHEMA = "seq bigint, table_name string, pk string, op string, payload map<string,string>"


def frame(spark, log):
    return spark.createDataFrame(log, SCHEMA).withColumn("key_name", F.lit("id"))


def as_dict(state):
    return {(r.table_name, r.pk): r.row for r in state.collect()}


@pytest.mark.parametrize("policy", ["upsert", "ignore", "replace"])
@pytest.mark.parametrize("bits", [3, 20])
def test_matches_sequential(spark, policy, bits):
    log = sequential.random_log(700, seed=11)
    want, refused = sequential.replay(log, policy)
    events = frame(spark, log)
    assert as_dict(replay.replay(events, policy)) == want
    if policy == "replace":
        got = sorted(r.seq for r in replay.key_violations(events, bits=bits).collect())
        assert got == sorted(refused)


@pytest.mark.parametrize("policy", ["ignore", "replace"])
def test_sparse_numbers_and_a_hot_key(spark, policy):
    """Numbers 2**21 apart and one key with nine tenths of the rows."""
    rng = random.Random(21)
    log = []
    for seq, table, key, *rest in sorted(sequential.random_log(500, seed=14)):
        log.append((seq << 21, table, "hot" if rng.random() < 0.9 else key, *rest))
    want, refused = sequential.replay(log, policy)
    events = frame(spark, log)
    assert as_dict(replay.replay(events, policy)) == want
    for bits in (8, 20):
        assert sorted(r.seq for r in replay.key_violations(events, bits=bits).collect()) == sorted(sequential.replay(log, "replace")[1])


def test_first_write_has_no_window(spark):
    """The last delete and the first write after it are aggregates: no task sorts a key's rows with their payloads."""
    plan = replay.replay(frame(spark, sequential.random_log(50, seed=15)), "ignore")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_wide_form_equals_map_form(spark):
    log = sequential.random_log(700, seed=12)
    want, _ = sequential.replay(log, "upsert")
    columns = {"id": "BIGINT", "a": "BIGINT", "b": "TEXT", "c": "DOUBLE"}
    rows = replay.replay_upsert_wide(frame(spark, log), columns).collect()
    assert len(rows) == len(want)
    for r in rows:
        row = want[(r.table_name, r.pk)]
        assert r.id == int(row["id"])
        assert r.a == (None if row.get("a") is None else int(row["a"]))
        assert r.b == row.get("b")
        assert r.c == (None if row.get("c") is None else float(row["c"]))


@pytest.mark.parametrize("policy", ["upsert", "ignore"])
def test_incremental_equals_whole(spark, policy):
    log = sorted(sequential.random_log(600, seed=13))
    want, _ = sequential.replay(log, policy)
    cuts = [0, 90, 100, 400, 600]
    state = {}
    for a, b in zip(cuts, cuts[1:]):
        held = spark.createDataFrame(
            [(t, k, row) for (t, k), row in state.items()], "table_name string, pk string, row map<string,string>"
        )
        state = as_dict(replay.apply_batch(held, frame(spark, log[a:b]), policy))
    assert state == want


def test_replace_checks_stored_rows(spark):
    held = spark.createDataFrame([("t0", "1", {"id": "1"})], "table_name string, pk string, row map<string,string>")
    log = [(5, "t0", "1", "insert", {"id": "1"}), (6, "t0", "2", "insert", {"id": "2"})]
    found = replay.key_violations(frame(spark, log), held).collect()
    assert [(r.pk, r.seq) for r in found] == [("1", 5)]
    after_delete = [(4, "t0", "1", "delete", {"id": "1"}), *log]
    assert replay.key_violations(frame(spark, after_delete), held).count() == 0


def test_shuffled_input_gives_same_state(spark):
    log = sequential.random_log(300, seed=14)
    mixed = list(log)
    random.Random(1).shuffle(mixed)
    a = as_dict(replay.replay(frame(spark, log)))
    b = as_dict(replay.replay(frame(spark, mixed).repartition(7)))
    assert a == b


def test_edge_orders(spark):
    log = [
        (0, "t", "1", "delete", {"id": "1"}),
        (1, "t", "1", "update", {"id": "1", "a": "x"}),
        (2, "t", "2", "update", {"id": "2"}),
        (3, "t", "3", "insert", {"id": "3", "a": "y"}),
        (4, "t", "3", "insert", {"id": "3", "a": None}),
        (5, "t", "3", "insert", {"id": "3", "b": "z"}),
        (6, "t", "4", "delete", {"id": "4"}),
    ]
    events = frame(spark, log)
    assert as_dict(replay.replay(events)) == {
        ("t", "1"): {"id": "1", "a": "x"},
        ("t", "2"): {"id": "2"},
        ("t", "3"): {"id": "3", "a": None, "b": "z"},
    }
    assert as_dict(replay.replay(events, "ignore"))[("t", "3")] == {"id": "3", "a": "y"}


def test_replace_appends_without_key(spark):
    rows = [(i, "log", None, "insert", {"a": str(i)}, None) for i in range(5)]
    rows += [(9, "keyed", "1", "insert", {"id": "1"}, "id"), (10, "keyed", None, "insert", {"a": "1"}, None)]
    events = spark.createDataFrame(rows, SCHEMA + ", key_name string")
    got = sorted((r.table_name, sorted(r.row.items())) for r in replay.replay(events, "replace").collect())
    assert got == [("keyed", [("id", "1")])] + [("log", [("a", str(i))]) for i in range(5)]


def test_violations(spark):
    rows = [
        (0, "t", "1", "insert", {"id": "1", "a": "1"}, "id"),
        (1, None, "1", "insert", {"id": "1", "a": "1"}, "id"),
        (2, "t", None, "insert", None, None),
        (3, "t", None, "insert", {"a": "1"}, None),
        (4, "t", None, "insert", {"id": None, "a": "1"}, "id"),
        (5, "t", "1", "insert", {"id": "1"}, "id"),
        (6, "t", None, "delete", {"a": "1"}, None),
        (7, "t", None, "delete", {"id": None}, "id"),
        (8, "t", None, "insert", {}, None),
    ]
    events = spark.createDataFrame(rows, SCHEMA + ", key_name string")

    def found(policy):
        return {r.seq: r.violation for r in replay.row_violations(events, policy).collect()}

    both = {1: "missing_table_name", 2: "bad_record", 4: "null_key"}
    assert found("upsert") == {**both, 3: "missing_key", 5: "empty_update", 8: "missing_key"}
    assert found("ignore") == {**both, 3: "missing_key", 8: "missing_key"}
    assert found("replace") == {**both, 8: "missing_key"}
    assert [r.seq for r in replay.skipped_deletes(events).collect()] == [6]
    with pytest.raises(ValueError):
        replay.replay(events, "merge")
