"""Flow statistics over the derived batch log."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import lookup, metrics
from rowtide.plans import logs
from rowtide.plans.registry import LOG, query

_BATCH_LOG = """batch AS (
  SELECT event_id // 100 AS batch_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS rows_in,
    count(*) FILTER (WHERE event_id % 97 = 0) AS rows_rejected
  FROM events GROUP BY 1)
, blog AS (
  SELECT 'users-flow' AS flow, s.sink, b.*, s.sink = 'backup' OR b.batch_id % 61 < 40 AS ok
  FROM batch b CROSS JOIN (SELECT 'primary' AS sink UNION ALL SELECT 'backup') s)
"""

# Length of the failure run each batch ends, by counting back to the last success.
_STREAKS = (
    _BATCH_LOG
    + """, islands AS (
  SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY flow, sink ORDER BY batch_id) AS island FROM blog)
, streaks AS (
  SELECT *, CASE WHEN ok THEN 0 ELSE
    sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY flow, sink, island ORDER BY batch_id) END AS streak
  FROM islands)
"""
)


@query(
    f"""WITH {_BATCH_LOG}
, edge AS (SELECT epoch_us(max(ts)) // 1000000 AS now_second FROM events)
, total AS (
  SELECT flow, sink, CAST(sum(rows_in) AS BIGINT) AS received,
    CAST(sum(CASE WHEN ok THEN rows_in - rows_rejected ELSE 0 END) AS BIGINT) AS written,
    CAST(sum(rows_rejected) AS BIGINT) AS rejected, count(*) FILTER (WHERE NOT ok) AS errors,
    'batch ' || max(batch_id) FILTER (WHERE NOT ok) || ' refused' AS last_error,
    (SELECT now_second FROM edge) - epoch_us(min(started_at)) // 1000000 AS uptime_seconds
  FROM blog GROUP BY flow, sink)
SELECT *, uptime_seconds // 3600 || 'h ' || (uptime_seconds % 3600) // 60 || 'm' AS uptime_text FROM total"""
)
def flow_stats(spark, sf_dir):
    # the instant of the report is data here, so that the result is repeatable
    last = logs.table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return metrics.flow_stats(logs.batch_log(spark, sf_dir), now=last)


@query(
    f"""WITH {_BATCH_LOG}
SELECT flow, sink, CAST(sum(rows_in) AS BIGINT) AS received,
  CAST(sum(CASE WHEN ok THEN rows_in - rows_rejected ELSE 0 END) AS BIGINT) AS written,
  count(*) FILTER (WHERE NOT ok) AS errors
FROM blog WHERE ended_at > TIMESTAMP '2024-01-15 00:00:00' GROUP BY flow, sink"""
)
def flow_stats_since(spark, sf_dir):
    since = F.lit("2024-01-15 00:00:00").cast("timestamp")
    stats = metrics.flow_stats(logs.batch_log(spark, sf_dir), since=since)
    return stats.select("flow", "sink", "received", "written", "errors")


@query("SELECT 'users-flow' AS flow, count(*) AS messages_received FROM events")
def flow_received(spark, sf_dir):
    return metrics.flow_received(logs.batch_log(spark, sf_dir))


@query(f"WITH {_STREAKS} SELECT flow, sink, batch_id, ok, CAST(streak AS BIGINT) AS streak FROM streaks")
def failure_streaks(spark, sf_dir):
    streaks = metrics.failure_streaks(logs.batch_log(spark, sf_dir))
    return streaks.select("flow", "sink", "batch_id", "ok", "streak")


@query(
    f"""WITH {_STREAKS}
SELECT flow, sink, batch_id, CAST(streak AS BIGINT) AS streak, 'batch ' || batch_id || ' refused' AS error, TRUE AS stop,
  '[CDC Alert] Flow ''' || flow || ''' stopped due to errors' AS subject,
  'Destination ' || sink || chr(10) || 'Consecutive errors: ' || CAST(streak AS BIGINT) || chr(10) || 'Error: batch ' || batch_id || ' refused' AS details
FROM streaks WHERE streak = 20"""
)
def threshold_alerts(spark, sf_dir):
    return metrics.threshold_alerts(logs.batch_log(spark, sf_dir))


@query(
    f"""WITH {LOG}
SELECT CAST(epoch_us(ts) // 60000000 * 60 AS BIGINT) AS minute_second, count(*) AS n FROM log GROUP BY 1"""
)
def throughput_minute(spark, sf_dir):
    series = metrics.throughput(logs.good_events(logs.change_log(spark, sf_dir)))
    return series.select(F.unix_seconds("interval_start").alias("minute_second"), "n")


@query(
    f"""WITH {LOG}
SELECT CAST(epoch_us(ts) // 60000000 * 60 AS BIGINT) AS minute_second, count(*) AS n FROM log GROUP BY 1
ORDER BY 1 DESC LIMIT 30"""
)
def newest_points(spark, sf_dir):
    series = metrics.throughput(logs.good_events(logs.change_log(spark, sf_dir)))
    newest = metrics.newest_points(series)
    return newest.select(F.unix_seconds("interval_start").alias("minute_second"), "n")


@query(
    """SELECT event_id, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5"""
)
def keep_last_n(spark, sf_dir):
    events = logs.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return lookup.keep_last_n(events, 5, "event_id", by="user_id")
