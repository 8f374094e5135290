"""Decoding, routing and text tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.functions.json_text import is_json_container
from rowtide.functions.text import format_uptime, format_uptime_dashboard, is_uuid_text
from rowtide.operators import envelope
from rowtide.plans import logs
from rowtide.plans.registry import DIRTY, LOG, query


def _record_columns():
    record, changes = F.col("record"), F.col("changes")
    return [
        F.get_json_object(record, "$.id").cast("bigint").alias("rec_id"),
        F.get_json_object(record, "$.event_type").alias("rec_type"),
        F.get_json_object(record, "$.value").cast("double").alias("rec_value"),
        F.get_json_object(changes, "$.k").cast("bigint").alias("chg_k"),
    ]


@query(
    f"""WITH {LOG}
SELECT seq, action, epoch_us(ts) AS ts_micros, user_id AS rec_id, event_type AS rec_type,
  val AS rec_value, k AS chg_k, 36 AS id_length
FROM log"""
)
def decode_events(spark, sf_dir):
    good = logs.good_events(logs.change_log(spark, sf_dir))
    return good.select(
        "seq",
        "action",
        F.unix_micros("timestamp").alias("ts_micros"),
        *_record_columns(),
        F.length("id").alias("id_length"),
    )


@query(
    f"""WITH {LOG}
SELECT seq, action, user_id AS rec_id, event_type AS rec_type, val AS rec_value, k AS chg_k,
  36 AS id_length, TRUE AS has_instant
FROM log"""
)
def make_events(spark, sf_dir):
    events = logs.source_events(spark, sf_dir).withColumn("seq", F.col("event_id"))
    made = envelope.make_events(
        events,
        record=F.to_json(F.struct(*logs.record_fields())),
        metadata=logs.metadata_text(F.lit("users")),
        action=logs.action_text(),
        changes=logs.changes_text(),
    )
    return made.select(
        "seq",
        "action",
        *_record_columns(),
        F.length("id").alias("id_length"),
        F.col("timestamp").isNotNull().alias("has_instant"),
    )


@query(
    f"""WITH {DIRTY}
SELECT CASE rule WHEN 97 THEN 'missing_action' ELSE 'not_an_object' END AS reason, count(*) AS n
FROM dirty WHERE rule IN (97, 89) GROUP BY 1"""
)
def rejects_by_reason(spark, sf_dir):
    return envelope.reject_counts(logs.rejects(logs.dirty_log(spark, sf_dir)))


@query(
    f"""WITH {DIRTY}
SELECT seq, CASE rule WHEN 97 THEN 'missing_action' ELSE 'not_an_object' END AS reason,
  CASE WHEN rule = 97 THEN user_id END AS rec_id,
  CASE WHEN rule = 89 THEN 40 END AS cut_length,
  TRUE AS shows_payload
FROM dirty WHERE rule IN (97, 89)"""
)
def reject_preview(spark, sf_dir):
    rejects = logs.rejects(logs.dirty_log(spark, sf_dir))
    whole = F.col("reason") == "missing_action"
    inner = F.get_json_object(F.get_json_object("payload", "$.record"), "$.id")
    return rejects.select(
        "seq",
        "reason",
        F.when(whole, inner.cast("bigint")).alias("rec_id"),
        F.when(~whole, F.length("payload")).alias("cut_length"),
        F.col("error").endswith(F.concat(F.lit(". Payload: "), F.col("payload"))).alias("shows_payload"),
    )


@query(
    f"""WITH {LOG}
SELECT seq, CASE WHEN seq % 97 = 0 THEN 'missing_action' END AS reject_reason,
  CASE WHEN seq % 97 <> 0 THEN action END AS action,
  user_id AS rec_id, event_type AS rec_type, val AS rec_value, k AS chg_k, 36 AS id_length
FROM log"""
)
def decode_entries(spark, sf_dir):
    decoded = envelope.decode_entries(logs.entry_log(spark, sf_dir))
    return decoded.select(
        "seq", "reject_reason", "action", *_record_columns(), F.length("id").alias("id_length")
    )


@query(
    f"""WITH {LOG}
SELECT seq, 'users_' || (user_id % 3) AS table_name, 'app' AS database_name, op FROM log"""
)
def route_tables(spark, sf_dir):
    routed = envelope.with_route(logs.good_events(logs.multi_table_log(spark, sf_dir)))
    return routed.select("seq", "table_name", "database_name", "op")


@query(
    f"""WITH {DIRTY}
SELECT seq, CASE WHEN rule IS NULL OR rule <> 83 THEN 'users' END AS table_name,
  rule IS NULL OR rule <> 73 OR op <> 'update' AS changes_ok, rule IS NOT DISTINCT FROM 79 AS record_bad
FROM decoded"""
)
def route_dirty(spark, sf_dir):
    events = logs.changes(logs.dirty_log(spark, sf_dir))
    return events.select(
        "seq", "table_name", "changes_ok", F.col("payload").isNull().alias("record_bad")
    )


@query(
    f"""WITH {LOG}
SELECT 'users_' || (user_id % 3) AS table_name, op, count(*) AS n FROM log GROUP BY 1, 2"""
)
def operation_counts(spark, sf_dir):
    return envelope.operation_counts(
        envelope.with_route(logs.good_events(logs.multi_table_log(spark, sf_dir)))
    )


@query("SELECT DISTINCT 'users_' || (user_id % 3) AS table_name FROM events")
def touched_tables(spark, sf_dir):
    return envelope.touched_tables(
        envelope.with_route(logs.good_events(logs.multi_table_log(spark, sf_dir)))
    )


@query(
    """SELECT event_id AS seq, event_id % 18 IN (9, 10) AS is_uuid, event_id % 18 IN (12, 13, 16, 17) AS is_json
FROM events"""
)
def text_classes(spark, sf_dir):
    log = logs.typed_log(spark, sf_dir)
    cell = F.get_json_object(F.get_json_object("value", "$.record"), "$.cell")
    texts = log.select("seq", cell.alias("cell"))
    return texts.select(
        "seq",
        F.coalesce(is_uuid_text(F.col("cell")), F.lit(False)).alias("is_uuid"),
        is_json_container(F.col("cell")).alias("is_json"),
    )


@query(
    """WITH s AS (SELECT event_id AS seq, event_id * 7 AS seconds FROM events)
, p AS (SELECT seq, seconds, seconds // 3600 AS h, (seconds % 3600) // 60 AS m, seconds % 60 AS r FROM s)
SELECT seq, seconds,
  CASE WHEN h > 0 THEN h || 'h ' || m || 'm' WHEN m > 0 THEN m || 'm ' || r || 's' ELSE r || 's' END AS uptime,
  h || 'h ' || m || 'm' AS dashboard
FROM p"""
)
def uptime_text(spark, sf_dir):
    seconds = F.col("event_id") * 7
    return logs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        seconds.alias("seconds"),
        format_uptime(seconds).alias("uptime"),
        format_uptime_dashboard(seconds).alias("dashboard"),
    )
