"""Change streams and bounded change logs from landed files.

Any source with a ``value`` column works with the same decoding; these readers
cover files, where the arrival order comes as a ``seq`` column, or, in text
files, as a number and a tab before each envelope. Text files of bare envelopes
are read with ``order="arrival"``: by the time of the file, its name and the
place in it. A message without a number otherwise ends among the rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.operators.sequence import number_rows

ORDERS = ("number", "arrival")
# What orders bare lines until they are numbered.
ARRIVAL = ["__time", "__file", "__block"]
# Sequence numbers of one micro-batch of bare lines.
BATCH_BITS = 32
COLUMN_FORMATS = ("parquet", "json", "orc")


def read_changes(
    spark: SparkSession,
    path: str,
    fmt: str = "text",
    mode: str = "stream",
    max_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = 256 << 20,
    start: str = "earliest",
    since: str | None = None,
    order: str = "number",
) -> DataFrame:
    """``seq, value``, one message per row.

    ``mode="stream"`` is unbounded and bounded in size per trigger;
    ``mode="batch"`` reads to the end. A new reader starts from the beginning,
    or with ``start="latest"`` after the instant ``since``; a reader that was
    stopped resumes from its checkpoint either way.

    ``order="arrival"`` takes text lines as they are. A bounded read numbers
    them at once; a stream carries what orders them, and ``run_flow`` numbers
    each micro-batch after the ones before it.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, not {order!r}")
    if max_per_trigger is not None:
        max_bytes_per_trigger = None  # a bound of its own
    reader = _reader(spark, mode, max_per_trigger, max_bytes_per_trigger)
    if fmt == "text":
        raw = _from_start(reader.text(path), start, since)
        if order == "arrival":
            file = F.col("_metadata")
            lines = raw.select(
                "value",
                file["file_modification_time"].alias("__time"),
                file["file_path"].alias("__file"),
                file["file_block_start"].alias("__block"),
            )
            return number_arrivals(lines) if mode == "batch" else lines.withColumn("seq", F.lit(None).cast("bigint"))
        return raw.select(
            F.regexp_extract("value", r"^(\d+)\t", 1).try_cast("bigint").alias("seq"),
            F.regexp_replace("value", r"^\d+\t", "").alias("value"),
        )
    if fmt not in COLUMN_FORMATS:
        raise ValueError(f"format must be text or one of {COLUMN_FORMATS}, not {fmt!r}")
    raw = reader.schema("seq BIGINT, value STRING").format(fmt).load(path)
    return _from_start(raw, start, since).select("seq", "value")


def number_arrivals(lines: DataFrame, batch_id: int = 0) -> DataFrame:
    """``seq, value`` of bare lines in the order of their arrival, after all earlier batches."""
    # rows of one block follow each other in their partition, in the file's order
    lines = lines.select("value", *ARRIVAL).withColumn("__line", F.monotonically_increasing_id())
    placed = number_rows(lines, [*ARRIVAL, "__line"], "seq")
    return placed.select((F.col("seq") + (batch_id << BATCH_BITS)).alias("seq"), "value")


def read_entries(
    spark: SparkSession,
    path: str,
    mode: str = "stream",
    max_per_trigger: int | None = None,
    start: str = "earliest",
    since: str | None = None,
) -> DataFrame:
    """``seq, entry_id, fields``: name -> bytes entries from Parquet files."""
    reader = _reader(spark, mode, max_per_trigger, None)
    raw = reader.schema("seq BIGINT, entry_id STRING, fields MAP<STRING,BINARY>").parquet(path)
    return _from_start(raw, start, since).select("seq", "entry_id", "fields")


def land_text(log: DataFrame, path: str) -> None:
    """Append ``seq, value`` rows as text files that ``read_changes`` understands."""
    log.select(F.concat_ws("\t", F.col("seq").cast("string"), "value").alias("value")).write.mode("append").text(path)


def _reader(spark, mode, max_files, max_bytes):
    if mode == "batch":
        return spark.read
    if mode != "stream":
        raise ValueError(f"mode must be 'stream' or 'batch', not {mode!r}")
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader


def _from_start(raw: DataFrame, start: str, since: str | None) -> DataFrame:
    if start == "earliest":
        return raw
    if start != "latest" or since is None:
        raise ValueError("start is 'earliest', or 'latest' with the instant 'since'")
    # a filter on the file's own time skips older files without reading them
    return raw.where(F.col("_metadata.file_modification_time") > F.lit(since).cast("timestamp"))
