"""Keyed merge of change logs, batches and their outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.functions.values import cast_raw
from rowtide.operators import batches, envelope, lookup, replay
from rowtide.plans import logs
from rowtide.plans.registry import DIRTY, LIVE, LOG, UPSERT, query
from rowtide.session import materialize, work_dir
from rowtide.sources.changes import read_changes

_UPSERT_ROWS = UPSERT + "SELECT * FROM final"


def _changes(spark, sf_dir):
    return logs.changes(logs.change_log(spark, sf_dir))


def _payload_columns(payload="payload"):
    return [
        cast_raw(F.col(payload)[name], data_type).alias(name) for name, data_type in logs.USERS_COLUMNS.items()
    ]


@query(f"WITH {LOG} SELECT seq, op, user_id AS id, event_type, val AS value, k FROM log")
def effective_payload(spark, sf_dir):
    return replay.effective_payload(_changes(spark, sf_dir)).select("seq", "op", *_payload_columns())


@query(
    f"""WITH {LOG}, w AS (SELECT * FROM log WHERE op <> 'delete')
SELECT 'users' AS table_name, user_id AS pk_id, seq, 'id' AS col, CAST(user_id AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt FROM w
UNION ALL SELECT 'users', user_id, seq, 'event_type', NULL, event_type FROM w
UNION ALL SELECT 'users', user_id, seq, 'value', val, NULL FROM w WHERE val IS NOT NULL
UNION ALL SELECT 'users', user_id, seq, 'k', CAST(k AS DOUBLE), NULL FROM w WHERE k IS NOT NULL"""
)
def event_cells(spark, sf_dir):
    cells = replay.cells(_changes(spark, sf_dir))
    is_text = F.col("col") == "event_type"
    return cells.select(
        "table_name",
        F.col("pk").cast("bigint").alias("pk_id"),
        "seq",
        "col",
        F.when(~is_text, F.col("val").cast("double")).alias("num"),
        F.when(is_text, F.col("val")).alias("txt"),
    )


@query(_UPSERT_ROWS)
def replay_upsert(spark, sf_dir):
    return replay.replay_upsert_wide(_changes(spark, sf_dir), logs.USERS_COLUMNS).drop("table_name", "pk")


@query(_UPSERT_ROWS)
def replay_upsert_map(spark, sf_dir):
    state = replay.replay(_changes(spark, sf_dir))
    return replay.to_table(state, "users", logs.USERS_COLUMNS)


@query(
    f"""WITH {LIVE}
SELECT user_id AS id, arg_min(event_type, seq) AS event_type,
  max(val) FILTER (WHERE seq = first_seq) AS value, max(k) FILTER (WHERE seq = first_seq) AS k
FROM (SELECT *, min(seq) OVER (PARTITION BY user_id) AS first_seq FROM live) GROUP BY user_id"""
)
def replay_ignore(spark, sf_dir):
    state = replay.replay(_changes(spark, sf_dir), "ignore")
    return replay.to_table(state, "users", logs.USERS_COLUMNS)


@query(
    f"""WITH {LOG}
, marked AS (SELECT *, lag(op) OVER (PARTITION BY user_id ORDER BY seq) AS previous_op FROM log)
SELECT 'users' AS table_name, CAST(user_id AS VARCHAR) AS pk, seq, op FROM marked
WHERE op <> 'delete' AND previous_op IS NOT NULL AND previous_op <> 'delete'"""
)
def replay_replace_violations(spark, sf_dir):
    events = _changes(spark, sf_dir).select("table_name", "pk", "seq", "op", "payload")
    return replay.key_violations(materialize(events, "changes"))


@query(
    f"""WITH {LIVE}
SELECT user_id AS id, min(seq) AS first_seq, arg_min(event_type, seq) AS event_type FROM live GROUP BY user_id"""
)
def replay_replace(spark, sf_dir):
    log = logs.changes(logs.change_log(spark, sf_dir))
    numbered = log.withColumn(
        "payload",
        F.when(F.col("op") == "delete", F.col("payload")).otherwise(
            F.map_concat("payload", F.create_map(F.lit("at"), F.col("seq").cast("string")))
        ),
    )
    state = replay.replay(numbered, "replace")
    return replay.to_table(state, "users", {"id": "BIGINT", "at": "BIGINT", "event_type": "TEXT"}).withColumnRenamed(
        "at", "first_seq"
    )


@query(
    f"""WITH {LOG}
, w AS (SELECT * FROM log WHERE op <> 'delete')
SELECT seq, event_type, val AS value, k FROM w"""
)
def replay_append(spark, sf_dir):
    """Replace policy on a table without key column: every write is a row."""
    events = logs.source_events(spark, sf_dir)
    _, event_type, value = logs.record_fields()
    record = F.to_json(F.struct(F.col("event_id").alias("seq"), event_type, value))
    text = logs.message(record, logs.metadata_text(F.lit("audit")), logs.action_text(), logs.changes_text())
    changes = logs.changes(events.select(F.col("event_id").alias("seq"), text.alias("value")))
    state = replay.replay(changes, "replace")
    return replay.to_table(state, "audit", {"seq": "BIGINT", "event_type": "TEXT", "value": "DOUBLE", "k": "BIGINT"})


def _halves(spark, sf_dir):
    columns = ["table_name", "pk", "seq", "op", "payload", "key_name"]
    events = materialize(_changes(spark, sf_dir).select(*columns), "changes")
    # two batches in arrival order, cut in the middle of the sequence
    middle = logs.table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).scalar()
    return events.where(F.col("seq") <= middle), events.where(F.col("seq") > middle)


@query(_UPSERT_ROWS)
def replay_incremental(spark, sf_dir):
    first, second = _halves(spark, sf_dir)
    held = materialize(replay.replay(first), "state")
    state = replay.apply_batch(held, second)
    return replay.to_table(state, "users", logs.USERS_COLUMNS)


@query(
    f"""WITH {DIRTY}
SELECT seq, batch_id FROM batched WHERE rule = 71 AND op = 'delete'"""
)
def skipped_deletes(spark, sf_dir):
    columns = ["seq", "op", "table_name", "payload", "key_name"]
    events = materialize(logs.changes(logs.dirty_log(spark, sf_dir)).select(*columns), "changes")
    return replay.skipped_deletes(batches.count_batches(events)).select("seq", "batch_id")


@query(f"WITH {DIRTY} SELECT seq, op, violation FROM decoded WHERE violation IS NOT NULL")
def row_violations(spark, sf_dir):
    return replay.row_violations(logs.changes(logs.dirty_log(spark, sf_dir))).select("seq", "op", "violation")


def _dirty_batches(spark, sf_dir, n=100):
    events = replay.with_violation(logs.changes(logs.dirty_log(spark, sf_dir))).select("seq", "op", "violation")
    return batches.count_batches(materialize(events, "checked"), n)


@query(
    f"""WITH {DIRTY}
SELECT batch_id, count(*) AS rows, count(violation) AS bad_rows, count(violation) = 0 AS ok,
  min(seq) FILTER (WHERE violation IS NOT NULL) AS error_seq,
  arg_min(violation, seq) FILTER (WHERE violation IS NOT NULL) AS first_error
FROM batched GROUP BY batch_id"""
)
def batch_outcome(spark, sf_dir):
    return batches.batch_outcome(_dirty_batches(spark, sf_dir))


@query(
    f"""WITH {DIRTY}
SELECT small_batch_id AS batch_id, seq, op FROM batched
WHERE small_batch_id NOT IN (SELECT small_batch_id FROM batched WHERE violation IS NOT NULL)"""
)
def committed_rows(spark, sf_dir):
    return batches.committed_rows(materialize(_dirty_batches(spark, sf_dir, n=20), "numbered")).select("batch_id", "seq", "op")


@query(
    f"""WITH {DIRTY}
SELECT small_batch_id AS batch_id, seq, op, violation FROM batched
WHERE small_batch_id IN (SELECT small_batch_id FROM batched WHERE violation IS NOT NULL)"""
)
def isolated_rows(spark, sf_dir):
    return batches.isolated_rows(materialize(_dirty_batches(spark, sf_dir, n=20), "numbered")).select("batch_id", "seq", "op", "violation")


@query(f"WITH {DIRTY} SELECT seq, batch_id FROM batched")
def count_batches(spark, sf_dir):
    good = logs.good_events(logs.dirty_log(spark, sf_dir)).select("seq")
    return batches.count_batches(materialize(good, "sequence"))


@query(
    f"""WITH {LOG}
SELECT CAST(epoch_us(ts) // 5000000 * 5 AS BIGINT) AS batch_second, count(*) AS n, min(seq) AS first_seq FROM log GROUP BY 1"""
)
def time_batches(spark, sf_dir):
    events = batches.time_batches(logs.good_events(logs.change_log(spark, sf_dir)))
    return events.groupBy(F.unix_seconds("batch_start").alias("batch_second")).agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq")
    )


@query(f"WITH {LOG} SELECT seq, user_id AS rec_id, action FROM log")
def dedup_events(spark, sf_dir):
    """Every event delivered twice, all delivered copies of one third a third time."""
    first = envelope.decode_envelope(logs.change_log(spark, sf_dir))
    copies = F.array(F.lit(0), F.lit(1), F.when(F.col("seq") % 3 == 0, F.lit(2)))
    span = F.lit(1 << 40)
    delivered = first.select("*", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("copy")).select(
        "id", "action", "record", (F.col("seq") + F.col("copy") * span).alias("seq")
    )
    return batches.dedup_events(delivered).select(
        "seq", F.get_json_object("record", "$.id").cast("bigint").alias("rec_id"), "action"
    )


@query(
    """SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'target' WHEN c_custkey % 3 = 1 THEN 'first' ELSE 'tie a' END AS origin
FROM customer"""
)
def insert_if_absent(spark, sf_dir):
    """Every customer comes again with an earlier, a tied, a later and an unordered row."""
    customers = logs.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = customers.where(F.col("c_custkey") % 3 == 0).withColumn("origin", F.lit("target"))
    has_first = F.col("c_custkey") % 3 == 1
    attempts = F.array(
        F.struct(F.lit(None).cast("int").alias("attempt"), F.lit("a without order").alias("origin")),
        F.struct(F.lit(2).alias("attempt"), F.lit("tie b").alias("origin")),
        F.struct(F.lit(2).alias("attempt"), F.lit("tie a").alias("origin")),
        F.struct(F.when(has_first, 1).otherwise(3).alias("attempt"), F.when(has_first, "first").otherwise("late").alias("origin")),
    )
    rows = customers.select("*", F.inline(attempts))
    return lookup.insert_if_absent(target, rows, "c_custkey", order="attempt")


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 3 > 0 THEN 1000 ELSE 2000 END AS created_second,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 2000 ELSE 1000 END AS updated_second
FROM customer WHERE c_custkey % 3 > 0 OR c_mktsegment = 'BUILDING'"""
)
def merge_audited(spark, sf_dir):
    """Every building customer is written four times; the last number, then the larger value, wins."""
    customers = logs.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    then = F.timestamp_seconds(F.lit(1000))
    target = customers.where(F.col("c_custkey") % 3 > 0).select(
        "c_custkey", "c_acctbal", then.alias("created_at"), then.alias("updated_at")
    )
    building = customers.where(F.col("c_mktsegment") == "BUILDING")
    turns = F.array(*[F.struct(F.lit(t).cast("int").alias("turn"), F.lit(x).alias("more")) for t, x in ((None, 9), (1, 8), (2, 1), (2, 2))])
    rows = building.select("c_custkey", "c_acctbal", F.inline(turns))
    rows = rows.select("c_custkey", (F.col("c_acctbal") + F.col("more")).alias("c_acctbal"), "turn")
    merged = lookup.merge_audited(target, rows, "c_custkey", F.timestamp_seconds(F.lit(2000)), order="turn")
    return merged.select(
        "c_custkey",
        "c_acctbal",
        F.unix_seconds("created_at").cast("int").alias("created_second"),
        F.unix_seconds("updated_at").cast("int").alias("updated_second"),
    )


@query(UPSERT + "SELECT id, event_type, value, k FROM final")
def replay_key_spellings(spark, sf_dir):
    """The same keys as ``5``, ``5.0`` and ``5e0`` in turn, in the changes of updates as well."""
    log = logs.change_log(spark, sf_dir)
    turn = (F.col("seq") % 3).cast("int")
    spelled = F.element_at(F.array(F.lit(""), F.lit(".0"), F.lit("e0")), turn + 1)
    # the record is a JSON text within the message
    respelled = F.regexp_replace("value", F.lit(r'(\\"id\\":\d+)'), F.concat(F.lit("$1"), spelled))
    state = replay.replay(logs.changes(log.select("seq", respelled.alias("value"))))
    return replay.to_table(state, "users", logs.USERS_COLUMNS)


@query(UPSERT + "SELECT id, event_type, value, k FROM final")
def replay_plain_files(spark, sf_dir):
    """Bare envelopes, one a line, read to the end in the order of their arrival."""
    path = f"{work_dir(spark, 'plain_files')}/in"
    # pieces land one after the other, each a file in order
    for piece in logs.pieces(logs.change_log(spark, sf_dir)):
        piece.repartition(1).sortWithinPartitions("seq").select("value").write.mode("append").text(path)
    state = replay.replay(logs.changes(read_changes(spark, path, mode="batch", order="arrival")))
    return replay.to_table(state, "users", logs.USERS_COLUMNS)
