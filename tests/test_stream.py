"""Flows over files: any split equals the whole, and failures lose nothing."""

import json
import time
from datetime import datetime, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rowtide.operators import batches, envelope, metrics, replay
from rowtide.operators.lookup import event_log
from rowtide.plans import logs
from rowtide.sources.changes import land_text, read_changes
from rowtide.streaming.flow import read_rejects, run_flow
from rowtide.streaming.live import FlowLog
from rowtide.streaming.seen import SeenEvents
from rowtide.streaming.store import EventLogStore, TableStore
from tests import sequential


def messages(spark, log, table=None):
    rows = []
    for seq, name, _, op, payload in log:
        text = json.dumps(
            {"record": json.dumps(payload), "metadata": json.dumps({"table_name": table or name}), "action": op}
        )
        rows.append((seq, text))
    return spark.createDataFrame(rows, "seq bigint, value string")


def land(spark, log, path, **options):
    land_text(messages(spark, log, **options).coalesce(1), str(path))


def drain(spark, base, sinks, files=1, **options):
    source = read_changes(spark, str(base / "in"), max_per_trigger=files)
    run_flow(source, sinks, str(base / "checkpoint"), available_now=True, **options).awaitTermination()


def as_dict(state):
    return {(r.table_name, r.pk): r.row for r in state.collect()}


def usable(log):
    """Without writes that carry nothing but their key, which fail a batch."""
    return [e for e in log if e[3] == "delete" or len(e[4]) > 1]


@pytest.mark.parametrize("pieces, files", [(1, 1), (3, 2)])
def test_any_split_equals_the_whole(spark, tmp_path, pieces, files):
    log = sorted(usable(sequential.random_log(160, seed=21)))
    want, _ = sequential.replay(log, "upsert")
    size = -(-len(log) // pieces)
    for i in range(pieces):
        land(spark, log[i * size : (i + 1) * size], tmp_path / "in")
    store = TableStore(spark, str(tmp_path / "tables"), buckets=3)
    drain(spark, tmp_path, [store], files)
    assert as_dict(store.state()) == want
    rows = {r.pk: r for r in store.table("t0").withColumn("pk", F.col("id").cast("string")).collect()}
    assert set(rows) == {pk for t, pk in want if t == "t0"}


def test_failure_of_a_later_sink_is_retried(spark, tmp_path):
    log = sorted(usable(sequential.random_log(120, seed=22)))
    want, _ = sequential.replay(log, "upsert")
    land(spark, log[:60], tmp_path / "in")
    land(spark, log[60:], tmp_path / "in")
    tables = TableStore(spark, str(tmp_path / "tables"), buckets=2)

    class Flaky(EventLogStore):
        broken = True

        def apply(self, events, batch_id, rejected=0, stream=""):
            if self.broken and batch_id == 1:
                raise RuntimeError("sink is down")
            return super().apply(events, batch_id, rejected, stream)

    events = Flaky(spark, str(tmp_path / "log"), "test")
    with pytest.raises(StreamingQueryException):
        drain(spark, tmp_path, [tables, events])
    assert events.read().count() == 60
    events.broken = False
    drain(spark, tmp_path, [tables, events])
    assert events.read().count() == len(log)
    assert as_dict(tables.state()) == want
    assert tables.ledger.rows().count() == 2


def test_crash_before_the_ledger_shows_the_old_state(spark, tmp_path, monkeypatch):
    log = sorted(usable(sequential.random_log(80, seed=23)))
    store = TableStore(spark, str(tmp_path / "tables"), buckets=2)
    first, second = (envelope.change_rows(envelope.split_rejects(
        envelope.decode_envelope(messages(spark, part)))[0]) for part in (log[:40], log[40:]))
    assert store.apply(first, 0)
    before = as_dict(store.state())
    with monkeypatch.context() as patched:
        patched.setattr(store.ledger, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.apply(second, 1)
    assert as_dict(store.state()) == before == sequential.replay(log[:40], "upsert")[0]
    assert store.apply(second, 1) and store.apply(second, 1)
    assert as_dict(store.state()) == sequential.replay(log, "upsert")[0]


def test_bad_row_fails_only_its_batch(spark, tmp_path):
    good = [(0, "t", "1", "insert", {"id": "1", "a": "x"}), (1, "t", "2", "insert", {"id": "2", "a": "x"})]
    bad = [(2, "t", "3", "insert", {"id": "3", "a": "x"}), (3, "t", None, "insert", {"a": "no key"})]
    late = [(4, "t", "1", "delete", {"id": "1"}), (5, "t", "2", "update", {"id": "2", "A": "upper"})]
    for part in (good, bad, late):
        land(spark, part, tmp_path / "in")
    spark.createDataFrame([("6\tbroken",)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    store = TableStore(spark, str(tmp_path / "tables"), buckets=2)
    drain(spark, tmp_path, [store], rejects_path=str(tmp_path / "rejects"))
    assert as_dict(store.state()) == {("t", "2"): {"id": "2", "a": "x", "A": "upper"}}
    ledger = {r.batch_id: (r.ok, r.error, r.rows_in, r.rows_written, r.rows_rejected) for r in store.ledger.rows().collect()}
    assert ledger == {
        0: (True, None, 2, 2, 0),
        1: (False, "missing_key", 2, 0, 0),
        2: (True, None, 2, 2, 0),
        3: (True, None, 1, 0, 1),
    }
    assert sorted((r.seq, r.violation) for r in store.failed().select("seq", "violation").collect()) == [
        (2, None), (3, "missing_key"),
    ]
    assert [(r.seq, r.payload) for r in read_rejects(spark, str(tmp_path / "rejects")).collect()] == [(6, "broken")]
    # names that differ only in case are two columns
    assert [tuple(r) for r in store.table("t").select("id", "a", "A").collect()] == [("2", "x", "upper")]


def test_policies_of_the_store(spark, tmp_path):
    rows = [(0, "t", "1", "insert", {"id": "1", "a": "x"})]
    again = [(1, "t", "1", "insert", {"id": "1", "a": "y"})]

    def events(log):
        return envelope.change_rows(envelope.split_rejects(envelope.decode_envelope(messages(spark, log)))[0])

    replace = TableStore(spark, str(tmp_path / "replace"), policy="replace", buckets=2)
    assert replace.apply(events(rows), 0) and not replace.apply(events(again), 1)
    assert as_dict(replace.state()) == {("t", "1"): {"id": "1", "a": "x"}}
    ignore = TableStore(spark, str(tmp_path / "ignore"), policy="ignore", buckets=2)
    assert ignore.apply(events(rows), 0) and ignore.apply(events(again), 1)
    assert as_dict(ignore.state()) == {("t", "1"): {"id": "1", "a": "x"}}
    closed = TableStore(spark, str(tmp_path / "closed"), auto_create=False, buckets=2)
    assert not closed.apply(events(rows), 0)
    assert closed.ledger.rows().first().error == "missing_table" and closed.state().count() == 0
    fixed = TableStore(spark, str(tmp_path / "replace"), auto_add=False, buckets=2)
    assert not fixed.apply(events([(2, "t", "1", "insert", {"id": "1", "b": "y"})]), 2)
    # the refused second insert is accepted once its key is gone
    assert replace.apply(events([(3, "t", "1", "delete", {"id": "1"})]), 3)
    assert replace.retry(1)
    assert as_dict(replace.state()) == {("t", "1"): {"id": "1", "a": "y"}}
    assert {r.batch for r in replace.failed().collect()} == {2}


def test_types_and_sample_scope_of_the_store(spark, tmp_path):
    def events(log):
        return envelope.change_rows(envelope.split_rejects(envelope.decode_envelope(messages(spark, log)))[0])

    first = [(0, "t", "1", "insert", {"id": 1, "n": 5}), (1, "t", "2", "insert", {"id": 2, "n": None})]
    wrong = [(2, "t", "3", "insert", {"id": 3, "n": "five"}), (3, "t", "1", "delete", {"id": 1})]
    strict = TableStore(spark, str(tmp_path / "strict"), buckets=2)
    assert strict.apply(events(first), 0) and not strict.apply(events(wrong), 1)
    assert strict.ledger.rows().where("not ok").first().error == "type_conflict"
    assert sorted(tuple(r) for r in strict.table("t").collect()) == [(1, 5), (2, None)]
    lax = TableStore(spark, str(tmp_path / "lax"), buckets=2, check_types=False)
    assert lax.apply(events(first), 0) and lax.apply(events(wrong), 1)
    assert sorted(tuple(r) for r in lax.table("t").collect()) == [(2, None), (3, None)]
    # the sample of a batch does not show a column of a later event
    sample = TableStore(spark, str(tmp_path / "sample"), buckets=2, scope="first")
    assert not sample.apply(events([*first, (4, "t", "4", "insert", {"id": 4, "late": 1})]), 0)
    assert sample.ledger.rows().first().error == "missing_column"


def test_ledger_is_the_batch_log(spark, tmp_path):
    log = [(0, "t", "1", "insert", {"id": "1", "a": "x"}), (1, "t", None, "insert", {"a": "no key"})]
    land(spark, log[:1], tmp_path / "in")
    land(spark, log[1:], tmp_path / "in")
    store = TableStore(spark, str(tmp_path / "tables"), buckets=2, flow="f")
    drain(spark, tmp_path, [store])
    stats = metrics.flow_stats(store.ledger.rows()).first()
    assert (stats.flow, stats.received, stats.written, stats.errors, stats.last_error) == ("f", 2, 1, 1, "missing_key")
    assert metrics.threshold_alerts(store.ledger.rows(), n=1).first().batch_id == 1


def test_odd_table_names(spark, tmp_path):
    log = [(i, name, "1", "insert", {"id": "1", "a": name}) for i, name in enumerate(["a/b", "A B", "a=b%", "ä", ""])]
    land(spark, log, tmp_path / "in")
    store = TableStore(spark, str(tmp_path / "tables"), buckets=2)
    drain(spark, tmp_path, [store])
    assert as_dict(store.state()) == sequential.replay(log, "upsert")[0]
    assert store.table("a/b").first().a == "a/b"


def test_pause_and_resume(spark, tmp_path):
    log = sorted(usable(sequential.random_log(60, seed=24)))
    store = TableStore(spark, str(tmp_path / "tables"), buckets=2)

    def start():
        return run_flow(
            read_changes(spark, str(tmp_path / "in")), [store], str(tmp_path / "checkpoint"), interval="100 milliseconds"
        )

    land(spark, log[:30], tmp_path / "in")
    flow = start()
    flow.processAllAvailable()
    flow.stop()
    land(spark, log[30:], tmp_path / "in")
    assert as_dict(store.state()) == sequential.replay(log[:30], "upsert")[0]
    flow = start()
    flow.processAllAvailable()
    flow.stop()
    assert as_dict(store.state()) == sequential.replay(log, "upsert")[0]


def test_start_positions_and_bounded_reads(spark, tmp_path):
    log = [(i, "t", str(i), "insert", {"id": str(i), "a": "x"}) for i in range(6)]
    land(spark, log[:2], tmp_path / "in")
    time.sleep(1.1)
    since = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    land(spark, log[2:], tmp_path / "in")
    path = str(tmp_path / "in")
    assert read_changes(spark, path, mode="batch").count() == 6
    assert read_changes(spark, path, mode="batch", start="latest", since=since).count() == 4
    sizes = []
    query = (
        read_changes(spark, path, max_per_trigger=1)
        .writeStream.foreachBatch(lambda df, i: sizes.append(df.count()))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sizes == [2, 4]
    latest = []
    query = (
        read_changes(spark, path, start="latest", since=since)
        .writeStream.foreachBatch(lambda df, i: latest.append(df.count()))
        .option("checkpointLocation", str(tmp_path / "d"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sum(latest) == 4
    for bad in ({"mode": "x"}, {"fmt": "x"}, {"start": "latest"}):
        with pytest.raises(ValueError):
            read_changes(spark, path, **bad)


def test_column_formats(spark, tmp_path):
    log = messages(spark, [(0, "t", "1", "insert", {"id": "1", "a": "x"})])
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        log.write.format(fmt).save(path)
        assert read_changes(spark, path, fmt=fmt, mode="batch").collect() == log.collect()


def test_replay_of_a_landed_log_as_a_batch(spark, tmp_path):
    log = usable(sequential.random_log(100, seed=25))
    land(spark, log, tmp_path / "in")
    decoded = envelope.decode_envelope(read_changes(spark, str(tmp_path / "in"), mode="batch"))
    events = envelope.change_rows(envelope.split_rejects(decoded)[0])
    assert as_dict(replay.replay(events)) == sequential.replay(log, "upsert")[0]


def changes(spark, log):
    return envelope.change_rows(envelope.split_rejects(envelope.decode_envelope(messages(spark, log)))[0])


def test_bare_envelopes_are_numbered_in_a_flow(spark, tmp_path):
    log = sorted(usable(sequential.random_log(90, seed=26)))
    for part in (log[:40], log[40:]):
        messages(spark, part).coalesce(1).select("value").write.mode("append").text(str(tmp_path / "in"))
    store = TableStore(spark, str(tmp_path / "tables"), buckets=2)
    source = read_changes(spark, str(tmp_path / "in"), max_per_trigger=1, order="arrival")
    run_flow(source, [store], str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert as_dict(store.state()) == sequential.replay(log, "upsert")[0]


def test_message_without_a_number_is_rejected(spark):
    rows = [(None, '{"record":"{}","metadata":"{}","action":"x"}'), (None, "broken"), (3, '{"record":"{}","metadata":"{}","action":"x"}')]
    decoded = envelope.decode_envelope(spark.createDataFrame(rows, "seq bigint, value string"))
    good, rejects = envelope.split_rejects(decoded)
    assert [r.seq for r in good.collect()] == [3]
    assert sorted((r.reason, r.payload) for r in rejects.collect()) == [("missing_seq", rows[0][1]), ("not_an_object", "broken")]
    entries = spark.createDataFrame([(None, "1-1", {"record": b"{}", "metadata": b"{}", "action": b"x"})], "seq bigint, entry_id string, fields map<string,binary>")
    assert envelope.decode_entries(entries).first().reject_reason == "missing_seq"


def test_new_checkpoint_and_second_flow_lose_nothing(spark, tmp_path):
    log = sorted(usable(sequential.random_log(90, seed=27)))
    for i, part in enumerate((log[:30], log[30:60], log[60:])):
        land(spark, part, tmp_path / f"in{i}")
        flow = "other" if i == 2 else "flow"
        store = TableStore(spark, str(tmp_path / "tables"), buckets=2, flow=flow)
        source = read_changes(spark, str(tmp_path / f"in{i}"))
        run_flow(source, [store], str(tmp_path / f"checkpoint{i}"), available_now=True).awaitTermination()
    assert as_dict(store.state()) == sequential.replay(log, "upsert")[0]
    assert sorted(r.flow for r in store.ledger.rows().collect()) == ["flow", "flow", "other"]


def test_bucket_count_belongs_to_the_store(spark, tmp_path):
    rows = [(0, "t", "1", "insert", {"id": "1", "a": "x"})]
    assert TableStore(spark, str(tmp_path / "t"), buckets=2).apply(changes(spark, rows), 0)
    with pytest.raises(ValueError, match="2 buckets"):
        TableStore(spark, str(tmp_path / "t"), buckets=3).apply(changes(spark, rows), 1)


def test_retry_keeps_what_is_newer(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), buckets=2, auto_add=False)
    assert store.failed().count() == 0
    assert store.apply(changes(spark, [(0, "t", "1", "insert", {"id": "1", "v": "a"}), (1, "t", "2", "insert", {"id": "2", "v": "a"})]), 0)
    old = [(2, "t", "1", "update", {"id": "1", "v": "old"}), (3, "t", "2", "update", {"id": "2", "v": "old", "w": "x"})]
    assert not store.apply(changes(spark, old), 1)
    assert store.apply(changes(spark, [(4, "t", "1", "update", {"id": "1", "v": "new"}), (5, "t", "2", "delete", {"id": "2"})]), 2)
    open_store = TableStore(spark, str(tmp_path / "t"), buckets=2)
    assert open_store.retry(1) and open_store.failed().count() == 0
    assert as_dict(open_store.state()) == {("t", "1"): {"id": "1", "v": "new"}}


def test_event_log_keeps_everything(spark, tmp_path):
    log = EventLogStore(spark, str(tmp_path / "log"), "s")
    rows = [
        (0, json.dumps({"record": '{"id":1,"v":"a"}', "metadata": '{"table_name":"t"}', "action": "update", "changes": '{"v":"b"}', "timestamp": "2024-01-02T00:00:00Z"})),
        (1, json.dumps({"record": '{"id":2}', "metadata": "{}", "action": "insert", "timestamp": "2024-01-03T00:00:00Z"})),
        (2, json.dumps({"record": "[1]", "metadata": '{"table_name":""}', "action": "update", "changes": "oops", "timestamp": "2024-01-03T00:00:00Z"})),
    ]
    decoded = envelope.decode_envelope(spark.createDataFrame(rows, "seq bigint, value string"))
    assert log.apply(envelope.change_rows(envelope.split_rejects(decoded)[0]), 0)
    got = sorted(((r.table_name or "-"), json.loads(r.data), r.changes) for r in log.read().collect() if r.table_name != "")
    assert got == [("-", {"id": 2}, None), ("t", {"id": 1, "v": "b"}, '{"v":"b"}')]
    assert [r.data for r in log.read().where("table_name = ''").collect()] == ["[1]"]
    assert log.ledger.rows().first().rows_written == 3 == log.read().count()
    day = event_log(log.read(), since=F.lit("2024-01-02 00:00:00").cast("timestamp"), until=F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert day.count() == 1
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_dedup_keeps_late_events(spark, tmp_path):
    rows = [("2024-03-01T00:00:00Z", "a"), ("2024-01-01T00:00:00Z", "b"), ("2024-03-01T00:00:00Z", "a")]
    for at, i in rows:
        spark.createDataFrame([(i, at)], "id string, timestamp string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id string, timestamp string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events = source.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    writer = batches.dedup_stream(events).writeStream.format("parquet").trigger(availableNow=True)
    writer.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_keys_of_one_value_meet(spark):
    log = [
        (0, {"record": '{"id":5,"a":"x"}', "action": "insert"}), (1, {"record": '{"id":5.0,"b":"y"}', "action": "update"}),
        (2, {"record": '{"id":7,"a":"x"}', "action": "insert"}), (3, {"record": '{"id":7e0}', "action": "delete"}),
        (4, {"record": '{"id":"5.0","a":"text"}', "action": "insert"}),
        (5, {"record": '{"id":1,"a":"x"}', "action": "update", "changes": '{"id":1.50}'}), (6, {"record": '{"id":1.5,"c":"z"}', "action": "insert"}),
    ]
    rows = [(i, json.dumps({"metadata": '{"table_name":"t"}', **m})) for i, m in log]
    decoded = envelope.decode_envelope(spark.createDataFrame(rows, "seq bigint, value string"))
    got = as_dict(replay.replay(envelope.change_rows(envelope.split_rejects(decoded)[0])))
    assert {k[1]: sorted(v) for k, v in got.items()} == {"5": ["a", "b", "id"], "5.0": ["a", "id"], "1.5": ["a", "c", "id"]}


def test_copies_at_any_distance(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "seq bigint, id string, ts string").select("seq", "id", F.col("ts").cast("timestamp").alias("timestamp"))

    seen = SeenEvents(spark, str(tmp_path / "seen"))

    def fresh(n, *rows):
        return sorted((r.seq, r.id) for r in seen.fresh(batch(*rows), n).collect())

    jan, feb = "2024-01-05 10:00:00", "2024-02-05 10:00:00"
    assert fresh(0, (2, "a", jan), (1, "a", jan), (3, "b", jan), (4, "n", None)) == [(1, "a"), (3, "b"), (4, "n")]
    assert fresh(1, (5, "c", feb), (6, "a", jan)) == [(5, "c")]
    # delivered again as a whole, also after a crash midway
    assert fresh(1, (5, "c", feb), (6, "a", jan)) == [(5, "c")]
    # a month later, beside new events
    assert fresh(2, (7, "b", jan), (8, "c", feb), (9, "d", feb), (10, "n", None)) == [(9, "d")]
    assert fresh(3, (11, "d", feb)) == []
    assert fresh(4) == []
    assert seen.known().count() == 5
    # an id that comes for another instant is another event's
    assert fresh(5, (12, "a", feb)) == [(12, "a")]


def test_event_log_skips_row_groups(spark, tmp_path):
    start = datetime(2024, 3, 1, tzinfo=timezone.utc).timestamp()
    moment = F.timestamp_seconds(F.lit(start) + F.pmod(F.col("id") * 7919, F.lit(80000)))
    events = spark.range(40000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), moment.alias("timestamp"), F.lit("t").alias("table_name"),
        F.lit("insert").alias("op"), F.to_json(F.struct("id", F.sha2(F.hex("id"), 256).alias("x"))).alias("record"),
        F.lit(None).cast("string").alias("changes"), F.lit("{}").alias("metadata"),
    ).coalesce(1)
    store = EventLogStore(spark, str(tmp_path / "log"), source="s", row_group_bytes=256 * 1024)
    store.apply(events, 0)

    def read_rows(found):
        plan = found._jdf.queryExecution().executedPlan()
        n = len(found.collect())
        scan = plan.collectLeaves().head()
        return n, scan.metrics().apply("numOutputRows").value()

    log = store.read()
    wanted = spark.range(1).select(F.sha2(F.lit("123"), 256)).first()[0]
    n, rows = read_rows(event_log(log, id=wanted))
    assert n == 1 and rows < 20000
    since, until = F.lit("2024-03-01 05:00:00").cast("timestamp"), F.lit("2024-03-01 05:10:00").cast("timestamp")
    n, rows = read_rows(event_log(log, since=since, until=until))
    assert n == events.where((F.col("timestamp") >= since) & (F.col("timestamp") < until)).count() > 0
    assert rows < 20000


def test_batches_are_counted_as_they_pass(spark, tmp_path):
    log = sorted(usable(sequential.random_log(90, seed=5)))
    for i in range(3):
        land(spark, log[30 * i : 30 * (i + 1)], tmp_path / "in")
    broken = spark.createDataFrame([(1000, "no json"), (1001, "{}")], "seq bigint, value string")
    land_text(broken.coalesce(1), str(tmp_path / "in"))
    store = EventLogStore(spark, str(tmp_path / "log"), "here", flow="one")
    live = FlowLog(spark, str(tmp_path / "flows"))
    other = FlowLog(spark, str(tmp_path / "others"))
    try:
        for _ in range(2):  # the second time there is nothing new
            source = read_changes(spark, str(tmp_path / "in"), max_per_trigger=1)
            flow = run_flow(source, [store], str(tmp_path / "checkpoint"), str(tmp_path / "rejects"), available_now=True, name="one", log=live)
            flow.awaitTermination()
            live.wait(flow)
    finally:
        live.close()
        other.close()
    rows = live.rows()
    assert [tuple(r) for r in rows.orderBy("batch_id").select("flow", "batch_id", "rows_in", "rows_rejected").collect()] == [
        ("one", i, n, bad) for i, (n, bad) in enumerate([(30, 0), (30, 0), (len(log) - 60, 0), (2, 2)])
    ]
    assert rows.where("ended_at < started_at OR NOT ok").isEmpty() and other.rows().isEmpty()
    assert read_rejects(spark, str(tmp_path / "rejects")).count() == 2 and store.read().count() == len(log)
    stats = metrics.flow_stats(rows).first()
    assert (stats.received, stats.rejected, stats.errors) == (len(log) + 2, 2, 0)


def test_bare_lines_have_no_live_log(spark, tmp_path):
    spark.createDataFrame([("{}",)], "value string").write.text(str(tmp_path / "in"))
    live = FlowLog(spark, str(tmp_path / "flows"))
    try:
        with pytest.raises(ValueError, match="live log"):
            run_flow(read_changes(spark, str(tmp_path / "in"), order="arrival"), [], str(tmp_path / "checkpoint"), log=live)
    finally:
        live.close()


def test_spread_log_has_the_same_rows_over_all_cores(spark, tmp_path):
    events = spark.range(200).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    # one file of one row group, one task
    events.unionByName(events.limit(5)).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for log in (logs.change_log, logs.defect_log):
        plain, dealt = log(spark, str(tmp_path)), log(spark, str(tmp_path), spread=True)
        sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == logs.spread_tasks(spark) and sum(sizes) == 205 and max(sizes) < 60
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_ids_are_judged_without_the_rest_of_their_events(spark, tmp_path):
    seen = SeenEvents(spark, str(tmp_path / "seen"))
    rows = [(1, "a", "2024-01-05"), (2, "a", "2024-01-05"), (3, None, None), (4, None, None)]
    batch = spark.createDataFrame(rows, "seq bigint, id string, at string").select(
        "seq", "id", F.col("at").cast("timestamp").alias("timestamp")
    )
    unread = batch.withColumn("record", F.raise_error(F.concat(F.lit("read "), F.col("seq").cast("string"))).cast("string"))
    fresh = seen.fresh(unread, 0)  # takes note of the ids
    assert sorted(r.id or "" for r in seen.known().collect()) == ["", "a"]
    with pytest.raises(Exception, match="read"):
        fresh.collect()
    assert sorted(r.seq for r in seen.fresh(batch, 0).collect()) == [1, 3]
    # an event without an id is new in every batch
    assert [r.id for r in seen.fresh(batch, 1).collect()] == [None]


def test_a_batch_is_kept_once(spark, tmp_path):
    kept = []

    class Sink:
        def apply(self, events, batch_id, rejected=0, stream=""):
            rows = sorted((r.seq, r.pk) for r in events.collect())
            kept.append((rows, rejected, spark.sparkContext._jsc.getPersistentRDDs().size() - before))
            return True

    land(spark, [(0, "t", "1", "insert", {"id": "1", "a": "x"})], tmp_path / "in")
    spark.createDataFrame([("6\tbroken",)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    run_flow(
        read_changes(spark, str(tmp_path / "in")), [Sink()], str(tmp_path / "c"), str(tmp_path / "rejects"), available_now=True
    ).awaitTermination()
    assert kept == [([(0, "1")], 1, 1)]
    assert [(r.seq, r.payload) for r in read_rejects(spark, str(tmp_path / "rejects")).collect()] == [(6, "broken")]
