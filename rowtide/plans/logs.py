"""Change logs derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.operators import envelope
from rowtide.session import configure

USERS_COLUMNS = {"id": "BIGINT", "event_type": "TEXT", "value": "DOUBLE", "k": "BIGINT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def source_events(
    spark: SparkSession, sf_dir: str, columns: list[str] | None = None, spread: bool = False
) -> DataFrame:
    """The events table, or the named columns of it.

    The file may have fewer row groups than there are cores. With ``spread``
    its rows are dealt over all of them before they grow into messages.
    """
    events = table(spark, sf_dir, "events")
    events = events.select(*(columns or events.columns))
    return events.repartition(spread_tasks(spark)) if spread else events


def spread_tasks(spark: SparkSession) -> int:
    return max(4, spark.sparkContext.defaultParallelism)


def action_text() -> Column:
    return (
        F.when(F.col("event_type") == "signup", "INSERT")
        .when(F.col("event_type") == "purchase", "snap")
        .when(F.col("event_type") == "error", "delete")
        .otherwise("update")
    )


def record_fields() -> list[Column]:
    return [
        F.col("user_id").alias("id"),
        F.col("event_type"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
    ]


def changes_text() -> Column:
    return F.when(F.col("event_type").isin("click", "view"), F.col("props"))


def metadata_text(table_name: Column) -> Column:
    return F.to_json(F.struct(table_name.alias("table_name"), F.lit("app").alias("database_name")))


def instant_text() -> Column:
    return F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def message(record: Column, metadata: Column, action: Column, changes: Column, timestamp: Column | None = None) -> Column:
    head = [] if timestamp is None else [timestamp.alias("timestamp")]
    return F.to_json(
        F.struct(
            *head,
            record.alias("record"),
            metadata.alias("metadata"),
            action.alias("action"),
            changes.alias("changes"),
        )
    )


def change_log(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``seq, value``: one envelope per event, all for table ``users``."""
    value = message(
        F.to_json(F.struct(*record_fields())), metadata_text(F.lit("users")), action_text(), changes_text(), instant_text()
    )
    return source_events(spark, sf_dir, spread=spread).select(F.col("event_id").alias("seq"), value.alias("value"))


def multi_table_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``change_log``, routed to ``users_0`` .. ``users_2``."""
    target = F.concat(F.lit("users_"), (F.col("user_id") % 3).cast("string"))
    value = message(
        F.to_json(F.struct(*record_fields())), metadata_text(target), action_text(), changes_text()
    )
    return source_events(spark, sf_dir).select(F.col("event_id").alias("seq"), value.alias("value"))


def dirty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``change_log`` with one defect per matching rule; the first rule wins."""
    def every(n):
        return F.col("event_id") % n == 0

    earlier = [97, 89, 83, 79, 73, 71]

    def rule(n):
        hit = every(n)
        for other in earlier[: earlier.index(n)]:
            hit = hit & ~every(other)
        return hit

    identity, event_type, value = record_fields()
    record = F.to_json(
        F.struct(F.when(~rule(71), F.col("user_id")).alias("id"), event_type, value)
    )
    text = message(
        F.when(rule(79), F.lit("[1]")).otherwise(record),
        F.when(rule(83), F.lit('{"table_name":5}')).otherwise(metadata_text(F.lit("users"))),
        F.when(~rule(97), action_text()),
        F.when(rule(73), F.lit("oops")).otherwise(changes_text()),
    )
    cut = F.when(rule(89), F.substring(text, 1, 40)).otherwise(text)
    return source_events(spark, sf_dir).select(F.col("event_id").alias("seq"), cut.alias("value"))


def defect_log(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``change_log`` with three of the defects of ``dirty_log`` and the number in the metadata."""
    def every(n):
        return F.col("event_id") % n == 0

    named = F.to_json(F.struct(F.lit("users").alias("table_name"), F.col("event_id").alias("seq")))
    unnamed = F.to_json(F.struct(F.lit(5).alias("table_name"), F.col("event_id").alias("seq")))
    text = message(
        F.to_json(F.struct(*record_fields())),
        F.when(every(83), unnamed).otherwise(named),
        F.when(~every(97), action_text()),
        changes_text(),
    )
    cut = F.when(every(89) & ~every(97), F.substring(text, 1, 40)).otherwise(text)
    return source_events(spark, sf_dir, spread=spread).select(F.col("event_id").alias("seq"), cut.alias("value"))


def drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``change_log`` whose last third brings a column ``extra``.

    For updates with ``event_id % 10 = 0`` it comes in the changes only.
    """
    events = source_events(spark, sf_dir)
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).scalar()
    late = F.col("event_id") * 3 >= 2 * (last + 1)
    in_changes = late & (F.col("event_id") % 10 == 0) & F.col("event_type").isin("click", "view")
    extra = F.when(late & ~in_changes, F.col("event_id")).alias("extra")
    record = F.to_json(F.struct(*record_fields(), extra))
    k = F.regexp_extract("props", r"-?\d+", 0).cast("bigint").alias("k")
    with_extra = F.to_json(F.struct(k, F.col("event_id").alias("extra")))
    value = message(
        record,
        metadata_text(F.lit("users")),
        action_text(),
        F.when(in_changes, with_extra).otherwise(changes_text()),
    )
    return events.select(F.col("event_id").alias("seq"), value.alias("value"))


def entry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``change_log`` as field-map entries; every 97th lacks its action."""
    fields = F.map_filter(
        F.create_map(
            F.lit("record"), F.to_json(F.struct(*record_fields())).cast("binary"),
            F.lit("metadata"), metadata_text(F.lit("users")).cast("binary"),
            F.lit("action"), F.when(F.col("event_id") % 97 != 0, action_text()).cast("binary"),
            F.lit("changes"), changes_text().cast("binary"),
        ),
        lambda _, v: v.isNotNull(),
    )
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return source_events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.concat(millis.cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("entry_id"),
        fields.alias("fields"),
    )


# One JSON value per type rule; ``typed_log`` cycles through them.
TYPED_VALUES = [
    ("null", "TEXT"),
    ("true", "BOOLEAN"),
    ("1", "BIGINT"),
    ("1.5", "DOUBLE"),
    ("1.0", "DOUBLE"),
    ("1e2", "DOUBLE"),
    ("18446744073709551615", "BIGINT"),
    ("18446744073709551616", "DOUBLE"),
    ("-9223372036854775808", "BIGINT"),
    ('"1b4e28ba-2fa1-11d2-883f-0016d3cca427"', "UUID"),
    ('" 1B4E28BA-2FA1-11D2-883F-0016D3CCA427 "', "UUID"),
    ('"1b4e28ba-2fa1-11d2-883f-0016d3cca4-7"', "TEXT"),
    ('"{\\"a\\":1}"', "JSONB"),
    ('" [1,2] "', "JSONB"),
    ('"{broken}"', "TEXT"),
    ('"plain"', "TEXT"),
    ("[1,2]", "JSONB"),
    ('{"a":{"b":1}}', "JSONB"),
]


def typed_log(spark: SparkSession, sf_dir: str, tables: int = len(TYPED_VALUES)) -> DataFrame:
    """Events whose column ``cell`` cycles through the type rules.

    Rule ``r`` goes to table ``kind_{r % tables}``; by default each table has
    one kind of value, with fewer tables several kinds meet in one column.
    """
    rule = F.col("event_id") % len(TYPED_VALUES)
    literal = F.element_at(F.array(*[F.lit(v) for v, _ in TYPED_VALUES]), rule.cast("int") + 1)
    record = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"cell":'), literal, F.lit("}"))
    target = F.concat(F.lit("kind_"), (rule % tables).cast("string"))
    value = message(record, metadata_text(target), F.lit("insert"), F.lit(None).cast("string"))
    return source_events(spark, sf_dir, ["event_id"]).select(
        F.col("event_id").alias("seq"), value.alias("value")
    )


def batch_log(spark: SparkSession, sf_dir: str, batch_size: int = 100) -> DataFrame:
    """One row per batch of events and sink, with runs of failures.

    Batch ``b`` fails when ``b % 61 >= 40``. Two sinks see every batch, the
    second one never fails.
    """
    events = table(spark, sf_dir, "events")
    started = F.min(F.col("ts").cast("timestamp"))
    batches = (
        events.groupBy((F.floor(F.col("event_id") / batch_size)).cast("bigint").alias("batch_id"))
        .agg(
            started.alias("started_at"),
            F.max(F.col("ts").cast("timestamp")).alias("ended_at"),
            F.count("*").alias("rows_in"),
            F.sum(F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("rows_rejected"),
        )
    )
    primary_ok = F.col("batch_id") % 61 < 40
    sinks = F.array(
        F.struct(F.lit("primary").alias("sink"), primary_ok.alias("ok")),
        F.struct(F.lit("backup").alias("sink"), F.lit(True).alias("ok")),
    )
    per_sink = batches.select(F.lit("users-flow").alias("flow"), "*", F.inline(sinks))
    return per_sink.select(
        "flow",
        "sink",
        "batch_id",
        "started_at",
        "ended_at",
        "rows_in",
        "rows_rejected",
        F.when(F.col("ok"), F.col("rows_in") - F.col("rows_rejected")).otherwise(F.lit(0)).cast("bigint").alias("rows_written"),
        "ok",
        F.when(~F.col("ok"), F.concat(F.lit("batch "), F.col("batch_id").cast("string"), F.lit(" refused"))).alias("error"),
    )


PIECES = 3


def pieces(log: DataFrame, n: int = PIECES) -> list[DataFrame]:
    """The log cut into ``n`` runs of its sequence, in order."""
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    width = (high - low) // n + 1
    return [log.where((F.col("seq") >= low + i * width) & (F.col("seq") < low + (i + 1) * width)) for i in range(n)]


def good_events(log: DataFrame) -> DataFrame:
    """Decoded messages of a log without its rejects."""
    return envelope.split_rejects(envelope.decode_envelope(log))[0]


def rejects(log: DataFrame) -> DataFrame:
    return envelope.split_rejects(envelope.decode_envelope(log))[1]


def changes(log: DataFrame) -> DataFrame:
    """Decoded, routed and keyed events of a log."""
    return envelope.change_rows(good_events(log))
