"""Flows over landed files of the derived logs, drained and read back."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from rowtide.operators import batches, envelope, metrics
from rowtide.operators.lookup import event_log
from rowtide.plans import logs
from rowtide.plans.registry import LIVE, LOG, UPSERT, query
from rowtide.session import materialize, work_dir
from rowtide.sources.changes import land_text, read_changes, read_entries
from rowtide.streaming.flow import read_rejects, run_flow
from rowtide.streaming.live import FlowLog
from rowtide.streaming.seen import SeenEvents
from rowtide.streaming.store import EventLogStore, TableStore

_USERS = UPSERT + "SELECT * FROM final"
# Messages of one micro-batch where files do not bound it.
BATCH_BYTES = 1 << 30


def _landed(log: DataFrame, path: str) -> int:
    """Land the pieces of a spread log; the number of files each may have.

    One piece after the other: file sources take files in the order they were
    written, so with as many per trigger each piece is one batch.
    """
    for piece in logs.pieces(log):
        land_text(piece, path)
    return logs.spread_tasks(log.sparkSession)


def _drain(source: DataFrame, sinks, root: str, **options) -> None:
    run_flow(source, sinks, f"{root}/checkpoint", available_now=True, **options).awaitTermination()


def _users(store: TableStore) -> DataFrame:
    return store.table("users").select(*logs.USERS_COLUMNS)


@query(_USERS)
def stream_replay(spark, sf_dir):
    root = work_dir(spark, "stream_replay")
    files = _landed(logs.change_log(spark, sf_dir, spread=True), f"{root}/in")
    store = TableStore(spark, f"{root}/tables", buckets=4)
    _drain(read_changes(spark, f"{root}/in", max_per_trigger=files), [store], root)
    return _users(store)


@query(
    f"""WITH {LIVE}
, final AS (
  SELECT user_id AS id, arg_max(event_type, seq) AS event_type,
    arg_max(val, seq) FILTER (WHERE val IS NOT NULL) AS value,
    arg_max(k, seq) FILTER (WHERE k IS NOT NULL) AS k
  FROM live GROUP BY user_id)
, bad AS (SELECT seq, CASE WHEN seq % 97 = 0 THEN 97 WHEN seq % 89 = 0 THEN 89 WHEN seq % 83 = 0 THEN 83 END AS rule FROM log)
SELECT 'table' AS name, CAST(id AS VARCHAR) AS key, event_type AS what, value AS num, k FROM final
UNION ALL SELECT 'log', CAST(seq AS VARCHAR), coalesce(CASE WHEN rule = 83 THEN 'no table' END, 'users'), NULL, NULL
  FROM bad WHERE rule IS NULL OR rule = 83
UNION ALL SELECT 'rejects', CAST(seq AS VARCHAR), CASE WHEN rule = 97 THEN 'missing_action' ELSE 'not_an_object' END, NULL, NULL
  FROM bad WHERE rule IN (97, 89)"""
)
def stream_fan_out(spark, sf_dir):
    """Two streams to two kinds of sinks: a clean one to a table, a dirty one to the event log and the rejects.

    A dirty batch would be refused by the table, so each log has its own flow; both flows have both sinks.
    """
    root = work_dir(spark, "stream_fan_out")
    files = _landed(logs.change_log(spark, sf_dir, spread=True), f"{root}/clean")
    table = TableStore(spark, f"{root}/tables", buckets=4, flow="clean")
    echo = EventLogStore(spark, f"{root}/echo", "clean", flow="clean")
    _drain(read_changes(spark, f"{root}/clean", max_per_trigger=2 * files), [table, echo], f"{root}/a")
    _landed(logs.defect_log(spark, sf_dir, spread=True), f"{root}/dirty")
    log = EventLogStore(spark, f"{root}/log", "dirty", flow="dirty")
    refused = TableStore(spark, f"{root}/refused", buckets=4, flow="dirty")
    source = read_changes(spark, f"{root}/dirty", max_per_trigger=2 * files)
    _drain(source, [log, refused], f"{root}/b", rejects_path=f"{root}/rejects")
    none = F.lit(None)
    users = _users(table).select(
        F.lit("table").alias("name"), F.col("id").cast("string").alias("key"), F.col("event_type").alias("what"), F.col("value").alias("num"), "k"
    )
    # events carry their number in the metadata
    logged = log.read().select(
        F.lit("log").alias("name"),
        F.get_json_object("metadata", "$.seq").alias("key"),
        F.coalesce("table_name", F.lit("no table")).alias("what"),
        none.cast("double").alias("num"),
        none.cast("bigint").alias("k"),
    )
    rejects = read_rejects(spark, f"{root}/rejects").select(
        F.lit("rejects").alias("name"), F.col("seq").cast("string").alias("key"), F.col("reason").alias("what"), none.cast("double").alias("num"), none.cast("bigint").alias("k")
    )
    return users.unionByName(logged).unionByName(rejects)


@query(
    f"""WITH {LOG}
SELECT 'dirty' AS flow, count(*) AS received, count(*) FILTER (WHERE seq % 97 = 0 OR seq % 89 = 0) AS rejected,
  CAST(0 AS BIGINT) AS errors
FROM log"""
)
def stream_live_counts(spark, sf_dir):
    """Statistics of a running flow from what its batches observed, without a job that counts."""
    root = work_dir(spark, "stream_live_counts")
    files = _landed(logs.defect_log(spark, sf_dir, spread=True), f"{root}/in")
    store = EventLogStore(spark, f"{root}/log", "dirty", flow="dirty")
    log = FlowLog(spark, f"{root}/flows")
    try:
        source = read_changes(spark, f"{root}/in", max_per_trigger=files)
        flow = run_flow(source, [store], f"{root}/checkpoint", f"{root}/rejects", available_now=True, name="dirty", log=log)
        flow.awaitTermination()
        log.wait(flow)
    finally:
        log.close()
    return metrics.flow_stats(log.rows()).select("flow", "received", "rejected", "errors")


@query(_USERS)
def stream_two_flows(spark, sf_dir):
    """Each half of the log by a flow of its own, with a checkpoint of its own, into one store."""
    root = work_dir(spark, "stream_two_flows")
    for name, half in zip(("first", "second"), logs.pieces(logs.change_log(spark, sf_dir, spread=True), 2), strict=True):
        land_text(half, f"{root}/{name}")
        store = TableStore(spark, f"{root}/tables", buckets=4, flow=name)
        _drain(read_changes(spark, f"{root}/{name}", max_bytes_per_trigger=BATCH_BYTES), [store], f"{root}/{name}-run")
    return _users(store)


@query(_USERS)
def stream_retry(spark, sf_dir):
    """The middle batch is refused for its table name, later ones are written, and it is retried last."""
    root = work_dir(spark, "stream_retry")
    store = TableStore(spark, f"{root}/tables", buckets=4)
    first, middle, last = (materialize(logs.changes(p), "piece") for p in logs.pieces(logs.change_log(spark, sf_dir, spread=True)))
    broken = middle.withColumn("table_name", F.when(F.col("seq") % 50 > 0, F.col("table_name")))
    assert store.apply(first, 0) and not store.apply(broken, 1) and store.apply(last, 2)
    held = store.failed().where("batch = 1")
    mended = held.withColumn("table_name", F.lit("users")).select(*middle.columns)
    assert store.apply(materialize(mended, "mended"), 1)
    return _users(store)


@query(_USERS)
def stream_crash(spark, sf_dir):
    """A run that ends before its last batch is in the ledger, and the same batch again."""
    root = work_dir(spark, "stream_crash")
    first, second, last = (materialize(logs.changes(p), "piece") for p in logs.pieces(logs.change_log(spark, sf_dir, spread=True)))
    store = TableStore(spark, f"{root}/tables", buckets=4)
    assert store.apply(first, 0)

    class Lost(Exception):
        pass

    def lost(*_, **__):
        raise Lost

    crashing = TableStore(spark, f"{root}/tables", buckets=4)
    crashing.ledger.write = lost
    try:
        crashing.apply(second, 1)
    except Lost:
        pass
    assert store.apply(second, 1) and store.apply(second, 1) and store.apply(last, 2)
    return _users(store)


@query(
    f"""WITH {LOG}, cut AS (SELECT min(seq) + (max(seq) - min(seq)) // 2 + 1 AS middle FROM log)
SELECT CAST(seq AS BIGINT) AS seq FROM log WHERE seq >= (SELECT middle FROM cut)"""
)
def stream_latest(spark, sf_dir):
    """A reader that starts after the first half has landed."""
    root = work_dir(spark, "stream_latest")
    first, second = logs.pieces(logs.change_log(spark, sf_dir, spread=True), 2)
    land_text(first, f"{root}/in")
    time.sleep(1.1)
    since = spark.sql("SELECT date_format(now(), 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS t").first()["t"]
    time.sleep(0.1)
    land_text(second, f"{root}/in")
    source = read_changes(spark, f"{root}/in", start="latest", since=since)
    writer = source.select("seq").writeStream.format("parquet").trigger(availableNow=True)
    writer.option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("seq")


@query(_USERS)
def stream_resume(spark, sf_dir):
    """Stopped after two pieces, resumed on the same checkpoint for the rest."""
    root = work_dir(spark, "stream_resume")
    store = TableStore(spark, f"{root}/tables", buckets=4)
    pieces = logs.pieces(logs.change_log(spark, sf_dir, spread=True))
    for part in (pieces[:2], pieces[2:]):
        for piece in part:
            land_text(piece, f"{root}/in")
        _drain(read_changes(spark, f"{root}/in", max_bytes_per_trigger=BATCH_BYTES), [store], root)
    return _users(store)


@query(
    f"""WITH {LOG}
SELECT epoch_us(ts) AS ts_micros, 'events' AS source, 'users_1' AS table_name, op AS operation, user_id AS rec_id,
  event_type, val AS value, k, CASE WHEN event_type IN ('click', 'view') THEN k END AS changed_k, 'app' AS database,
  true AS id_is_there, true AS is_stamped
FROM log WHERE user_id % 3 = 1 AND op = 'update'"""
)
def event_log_append(spark, sf_dir):
    root = work_dir(spark, "event_log_append")
    timed = logs.source_events(spark, sf_dir, spread=True)
    target = F.concat(F.lit("users_"), (F.col("user_id") % 3).cast("string"))
    text = logs.message(
        F.to_json(F.struct(*logs.record_fields())), logs.metadata_text(target), logs.action_text(),
        logs.changes_text(), logs.instant_text(),
    )
    _landed(timed.select(F.col("event_id").alias("seq"), text.alias("value")), f"{root}/in")
    store = EventLogStore(spark, f"{root}/log", "events")
    _drain(read_changes(spark, f"{root}/in"), [store], root)
    found = event_log(store.read(), table="users_1", operation="update")

    def field(text: str, path: str, kind: str):
        return F.get_json_object(text, path).cast(kind)

    return found.select(
        F.unix_micros("timestamp").alias("ts_micros"),
        "source",
        "table_name",
        "operation",
        field("data", "$.id", "bigint").alias("rec_id"),
        field("data", "$.event_type", "string").alias("event_type"),
        field("data", "$.value", "double").alias("value"),
        field("data", "$.k", "bigint").alias("k"),
        field("changes", "$.k", "bigint").alias("changed_k"),
        field("metadata", "$.database_name", "string").alias("database"),
        F.col("id").isNotNull().alias("id_is_there"),
        F.col("created_at").isNotNull().alias("is_stamped"),
    )


@query(
    f"""WITH {LOG}
SELECT 'users' AS table_name, op AS operation, count(*) AS n FROM log WHERE seq % 97 <> 0 GROUP BY op"""
)
def stream_entries(spark, sf_dir):
    """Field-map entries as a stream source."""
    root = work_dir(spark, "stream_entries")
    logs.entry_log(spark, sf_dir).write.parquet(f"{root}/in")
    store = EventLogStore(spark, f"{root}/log", "entries")
    _drain(read_entries(spark, f"{root}/in"), [store], root, decode=envelope.decode_entries)
    return store.read().groupBy("table_name", "operation").agg(F.count("*").alias("n"))


@query(
    f"""WITH {LOG}
SELECT CAST(epoch_us(ts) // 60000000 * 60 AS BIGINT) AS minute_second, count(*) AS n FROM log GROUP BY 1"""
)
def stream_throughput(spark, sf_dir):
    """Per-minute counts kept by the stream itself."""
    root = work_dir(spark, "stream_throughput")
    files = _landed(logs.change_log(spark, sf_dir, spread=True), f"{root}/in")
    decoded = envelope.decode_envelope(read_changes(spark, f"{root}/in", max_per_trigger=2 * files))
    series = metrics.throughput(envelope.split_rejects(decoded)[0], late="10 minutes")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/series/batch={batch_id}")

    writer = series.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()
    # later batches carry larger counts of the minutes they touched
    updates = spark.read.parquet(f"{root}/series")
    latest = updates.groupBy("interval_start").agg(F.max_by("n", "batch").alias("n"))
    return latest.select(F.unix_seconds("interval_start").alias("minute_second"), "n")


@query(f"WITH {LOG} SELECT user_id AS rec_id, action, count(*) AS n FROM log GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """Every message delivered twice, reduced to one by the stream."""
    root = work_dir(spark, "stream_dedup")
    for piece in logs.pieces(logs.change_log(spark, sf_dir, spread=True)):
        twice = piece.select("seq", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
        land_text(twice, f"{root}/in")
    files = logs.spread_tasks(spark)
    decoded = envelope.decode_envelope(read_changes(spark, f"{root}/in", max_per_trigger=2 * files))
    once = batches.dedup_stream(envelope.split_rejects(decoded)[0], "id", late="1 day")
    writer = once.select("id", "action", "record").writeStream.format("parquet").trigger(availableNow=True)
    writer.option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()
    rec_id = F.get_json_object("record", "$.id").cast("bigint").alias("rec_id")
    return spark.read.parquet(f"{root}/out").groupBy(rec_id, "action").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT user_id AS rec_id, action, count(*) AS n FROM log GROUP BY 1, 2")
def stream_dedup_late(spark, sf_dir):
    """Every message delivered again after all the others, counted once without a watermark."""
    root = work_dir(spark, "stream_dedup_late")
    log = materialize(logs.change_log(spark, sf_dir, spread=True), "log")
    for piece in logs.pieces(log) + logs.pieces(log, 1):
        land_text(piece, f"{root}/in")
    source = read_changes(spark, f"{root}/in", max_per_trigger=logs.spread_tasks(spark))
    good = envelope.split_rejects(envelope.decode_envelope(source))[0]
    seen = SeenEvents(spark, f"{root}/seen")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select("seq", "id", "timestamp", "action", "record").persist()
        fresh = seen.fresh(batch, batch_id).select("id", "action", "record")
        fresh.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        batch.unpersist()

    writer = good.writeStream.foreachBatch(write).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()
    rec_id = F.get_json_object("record", "$.id").cast("bigint").alias("rec_id")
    return spark.read.parquet(f"{root}/out").groupBy(rec_id, "action").agg(F.count("*").alias("n"))
