"""Tables kept as versioned Parquet files behind a ledger.

A batch first writes the new version of every file bucket it touches, then the
catalog and the list of current buckets, and last one ledger row. Readers go
from the ledger to the version it names, so a batch is seen whole or not at
all, and a batch that is run again finds its ledger row and does nothing.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rowtide.functions.frames import read_or_empty
from rowtide.operators import replay, schema
from rowtide.operators.lookup import append_event_log, table_dir

# Layouts of what is stored.
STATE = (
    "table_name STRING, pk STRING, row MAP<STRING,STRING>, at MAP<STRING,BIGINT>, put_seq BIGINT, del_seq BIGINT"
)
CATALOG = (
    "schema_name STRING, table_name STRING, column_name STRING, data_type STRING, ordinal INT, last_updated TIMESTAMP"
)
MANIFEST = "table_name STRING, table_dir STRING, bucket INT, data_version BIGINT"
_ERROR = "struct<seq: bigint, rank: int, violation: string>"
LEDGER = (
    "flow_name STRING, sink_name STRING, batch_id BIGINT, started_at TIMESTAMP, ended_at TIMESTAMP, rows_in BIGINT, "
    "rows_rejected BIGINT, rows_written BIGINT, ok BOOLEAN, error STRING, version BIGINT"
)
# Folders that anything of a batch lies in.
PLACE = ", flow STRING, sink STRING, stream STRING, batch BIGINT"


def _folder(text: str) -> str:
    """A name as part of a path, whatever characters it has."""
    return "n" + text.encode().hex()


class Ledger:
    """One row per batch, each in its own folder, so a row is written once.

    Batches are known by flow, sink, stream and number: several flows may write
    to one store, one after the other, and a new checkpoint starts a stream of
    its own.
    """

    def __init__(self, spark: SparkSession, root: str, flow: str, sink: str):
        self.spark, self.path, self.flow, self.sink = spark, f"{root}/ledger", flow, sink

    def place(self, batch_id: int, stream: str = "") -> str:
        """Where anything of one batch is kept, below a root."""
        return f"flow={_folder(self.flow)}/sink={_folder(self.sink)}/stream={_folder(stream)}/batch={batch_id}"

    def rows(self) -> DataFrame:
        """Every batch so far, with ``flow`` and ``sink`` by name."""
        rows = read_or_empty(self.spark, self.path, LEDGER + PLACE)
        named = rows.withColumns({"flow": F.col("flow_name"), "sink": F.col("sink_name")})
        return named.drop("flow_name", "sink_name")

    def done(self, batch_id: int, stream: str = "") -> bool:
        """Whether the batch was written already; looks at its own row only."""
        return bool(read_or_empty(self.spark, f"{self.path}/{self.place(batch_id, stream)}", LEDGER).where("ok").take(1))

    def last_version(self) -> int | None:
        return self.rows().where("ok").agg(F.max("version")).first()[0]

    def write(self, batch_id, started, rows_in, rows_written, ok, error, version, rejected=0, stream="") -> None:
        row = (self.flow, self.sink, batch_id, started, time.time(), rows_in, rejected, rows_written, ok, error, version)
        frame = self.spark.createDataFrame(
            [row],
            "flow_name STRING, sink_name STRING, batch_id BIGINT, started_at DOUBLE, ended_at DOUBLE, rows_in BIGINT, "
            "rows_rejected BIGINT, rows_written BIGINT, ok BOOLEAN, error STRING, version BIGINT",
        )
        frame = frame.withColumns(
            {c: F.timestamp_micros((F.col(c) * 1000000).cast("bigint")) for c in ("started_at", "ended_at")}
        )
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.place(batch_id, stream)}")


class TableStore:
    """Sink that replays batches into tables named by their events.

    Files are split by table and by a hash of the key; a batch rewrites only
    the buckets its keys fall into. Upsert state keeps the sequence numbers of
    its writes, so a refused batch can be retried after later ones. The number
    of buckets is part of the store: opened with another one, it refuses to
    write. Flows that share a store write in turn, and number their events in
    one common order.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        policy: str = "upsert",
        buckets: int = 64,
        auto_create: bool = True,
        auto_add: bool = True,
        scope: str = "batch",
        check_types: bool = True,
        schema_name: str = "public",
        flow: str = "flow",
        sink: str = "tables",
    ):
        self.spark, self.root, self.policy, self.buckets = spark, root.rstrip("/"), policy, buckets
        self.auto_create, self.auto_add, self.scope, self.check_types = auto_create, auto_add, scope, check_types
        self.schema_name, self.name = schema_name, sink
        self.ledger = Ledger(spark, self.root, flow, sink)
        self.checked = False

    # ---- reading

    def catalog(self, version: int | None = None) -> DataFrame:
        version = self.ledger.last_version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], CATALOG)
        return self.spark.read.schema(CATALOG).parquet(f"{self.root}/catalog/version={version}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """Current files: one row per table and bucket, however large the data."""
        version = self.ledger.last_version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version}")

    def state(self, table: str | None = None) -> DataFrame:
        manifest = self.manifest()
        wanted = manifest if table is None else manifest.where(F.col("table_name") == table)
        return replay.live_rows(self._read_buckets(wanted))

    def table(self, name: str) -> DataFrame:
        """Typed rows of one table."""
        return replay.to_table(self.state(name), name, schema.column_types(self.catalog(), name))

    def tables(self) -> DataFrame:
        return self.catalog().select("table_name").distinct()

    def failed(self) -> DataFrame:
        """Events of the batches that are still refused, with batch and violation."""
        try:
            events = self.spark.read.parquet(f"{self.root}/failed")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], "seq BIGINT, batch BIGINT, violation STRING")
        refused = self.ledger.rows().where(~F.col("ok")).select(
            _folder_column("flow"), _folder_column("sink"), "stream", "batch"
        )
        return events.join(refused, ["flow", "sink", "stream", "batch"], "left_semi").drop("flow", "sink", "stream")

    def retry(self, batch_id: int, stream: str = "") -> bool:
        """Run a refused batch again; what was written since and is newer stays."""
        path = f"{self.root}/failed/{self.ledger.place(batch_id, stream)}"
        return self.apply(self.spark.read.parquet(path).drop("violation"), batch_id, stream=stream)

    def _check_buckets(self) -> None:
        path = f"{self.root}/settings"
        stored = read_or_empty(self.spark, path, "buckets INT").first()
        if stored is None:
            settings = self.spark.createDataFrame([(self.buckets,)], "buckets INT")
            settings.coalesce(1).write.mode("overwrite").parquet(path)
        elif stored["buckets"] != self.buckets:
            raise ValueError(f"the store has {stored['buckets']} buckets, not {self.buckets}")
        self.checked = True

    def _read_buckets(self, manifest: DataFrame) -> DataFrame:
        # the list of files, not their rows: tables x buckets at most
        current = manifest.select("data_version", "table_dir", "bucket").collect()
        if not current:
            return self.spark.createDataFrame([], STATE)
        base = f"{self.root}/data"
        paths = [f"{base}/version={r.data_version}/table_dir={r.table_dir}/bucket={r.bucket}" for r in current]
        return self.spark.read.schema(STATE).option("basePath", base).parquet(*paths).select(*replay.VERSION_COLUMNS)

    # ---- writing

    def apply(self, events: DataFrame, batch_id: int, rejected: int = 0, stream: str = "") -> bool:
        """Write one batch of routed, keyed events; False when it was refused."""
        if self.ledger.done(batch_id, stream):
            return True
        if not self.checked:
            self._check_buckets()
        started = time.time()
        current = self.ledger.last_version()
        # the next number whatever the batch: a run cut short left nothing in
        # the ledger and its files are written over
        version = 0 if current is None else current + 1
        catalog = self.catalog(current)
        kinds = schema.cell_kinds(events).persist()
        try:
            grown = self._grow_catalog(events, kinds, catalog, version)
            clashes = schema.conflicting_kinds(kinds.where(~F.col("is_delete")), grown)
            rows, error = self._outcome(events, self._violations(events, clashes, catalog, grown, current))
            if not rows:
                self.ledger.write(batch_id, started, rejected, 0, True, None, current, rejected, stream)
                return True
            if error is not None:
                # only a refused batch is looked through row by row
                cells = schema.typed_cells(events.where(F.col("op") != "delete"), effective=True)
                clashes = schema.conflicting_cells(cells, grown).select("seq")
                bad = self._violations(events, clashes, catalog, grown, current)
                self._isolate(events, bad, self.ledger.place(batch_id, stream))
                self.ledger.write(batch_id, started, rows + rejected, 0, False, error, current, rejected, stream)
                return False
        finally:
            kinds.unpersist()
        self._write_version(events, current, version)
        self.ledger.write(batch_id, started, rows + rejected, rows, True, None, version, rejected, stream)
        return True

    def _grow_catalog(self, events, kinds, catalog: DataFrame, version: int) -> DataFrame:
        first_only = self.scope == "first"
        inferred = schema.infer_schema(events, "first") if first_only else schema.infer_from_cells(kinds)
        path = f"{self.root}/catalog/version={version}"
        grown = schema.extend_catalog(catalog, inferred, self.schema_name)
        grown.coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(CATALOG).parquet(path)

    def _violations(self, events, clashes, catalog: DataFrame, grown: DataFrame, current: int | None) -> DataFrame:
        """``seq, rank, violation`` of every row that cannot be written; nothing when all can.

        ``clashes`` has the numbers of rows with values of another type: all of
        them, or at least the first.
        """
        checks = [replay.row_violations(events, self.policy).select("seq", "violation")]
        if not (self.auto_create and self.auto_add):
            refused = schema.schema_violations(events, catalog, self.auto_create, self.auto_add)
            checks.append(refused.select("seq", "violation"))
        if self.scope == "first":
            # columns the sample did not show are not in the table
            unseen = schema.schema_violations(events, grown, auto_add=False)
            checks.append(unseen.select("seq", "violation"))
        if self.check_types:
            checks.append(clashes.select("seq", F.lit("type_conflict").alias("violation")))
        if self.policy == "replace":
            held = replay.live_rows(self._read_buckets(self._touched(events, current)))
            again = replay.key_violations(events, held).select("seq")
            checks.append(again.withColumn("violation", F.lit("duplicate_key")))
        ranked = [c.select("seq", F.lit(i).alias("rank"), "violation") for i, c in enumerate(checks)]
        return reduce(DataFrame.unionByName, ranked)

    @staticmethod
    def _outcome(events: DataFrame, bad: DataFrame) -> tuple[int, str | None]:
        """Number of rows, and the error of the earliest bad one."""
        counted = events.select(F.lit(1).alias("n"), F.lit(None).cast(_ERROR).alias("error"))
        errors = bad.select(F.lit(0).alias("n"), F.struct("seq", "rank", "violation").cast(_ERROR).alias("error"))
        found = counted.unionByName(errors).agg(F.sum("n").alias("n"), F.min("error").alias("error")).first()
        return found["n"] or 0, found["error"] and found["error"]["violation"]

    def _isolate(self, events: DataFrame, bad: DataFrame, place: str) -> None:
        first = bad.groupBy("seq").agg(F.min_by("violation", "rank").alias("violation"))
        path = f"{self.root}/failed/{place}"
        events.join(first, "seq", "left").write.mode("overwrite").parquet(path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Append the folder of the table and the bucket of the key."""
        return rows.withColumns(
            {
                "table_dir": table_dir(F.col("table_name")),
                "bucket": F.pmod(F.xxhash64(F.coalesce("pk", F.lit(""))), F.lit(self.buckets)).cast("int"),
            }
        )

    def _touched(self, events: DataFrame, version: int | None) -> DataFrame:
        """Manifest rows of the buckets a batch falls into."""
        places = self._placed(events.select("table_name", "pk")).select("table_dir", "bucket").distinct()
        return self.manifest(version).join(places, ["table_dir", "bucket"], "left_semi")

    def _write_version(self, events: DataFrame, current: int | None, version: int) -> None:
        touched = self._touched(events, current)
        stored = self._read_buckets(touched)
        if self.policy == "upsert":
            after = replay.apply_batch(stored, events)
        else:
            after = replay.apply_batch(replay.live_rows(stored), events, self.policy)
            empty = {"at": "map<string,bigint>", "put_seq": "bigint", "del_seq": "bigint"}
            after = after.withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()})
        after = self._placed(after)
        # one folder per table and bucket; large ones are split, small ones merged
        after.hint("rebalance", "table_dir", "bucket").write.mode("overwrite").partitionBy(
            "table_dir", "bucket"
        ).parquet(f"{self.root}/data/version={version}")

        written = read_or_empty(
            self.spark, f"{self.root}/data/version={version}", f"{STATE}, table_dir STRING, bucket INT"
        )
        fresh = written.select(
            "table_name", "table_dir", "bucket", F.lit(version).cast("bigint").alias("data_version")
        ).distinct()
        # buckets whose last row was deleted leave the list
        kept = self.manifest(current).join(touched.select("table_dir", "bucket"), ["table_dir", "bucket"], "left_anti")
        columns = ["table_name", "table_dir", "bucket", "data_version"]
        kept.select(*columns).unionByName(fresh.select(*columns)).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/version={version}"
        )


def _folder_column(name: str):
    return F.concat(F.lit("n"), F.lower(F.hex(F.encode(name, "UTF-8")))).alias(name)


class EventLogStore:
    """Sink that appends every event with its operation, table and payload.

    Folders follow the day and the table, so a lookup by time or table opens
    only theirs; events without a table have a folder of their own. Files are
    sorted by time and have Bloom filters of the ids, so that a lookup inside a
    day skips row groups.
    """

    # The log's columns, then its folders.
    LAYOUT = (
        "id STRING, timestamp TIMESTAMP, source STRING, table_name STRING, operation STRING, data STRING, "
        "changes STRING, metadata STRING, created_at TIMESTAMP"
    )
    FOLDERS = PLACE + ", event_date DATE, table_dir STRING"

    def __init__(
        self, spark: SparkSession, root: str, source: str, flow: str = "flow", sink: str = "event_log",
        row_group_bytes: int = 32 * 2**20,
    ):
        self.spark, self.root, self.source, self.name = spark, root.rstrip("/"), source, sink
        self.files = {
            "parquet.block.size": row_group_bytes,
            "parquet.bloom.filter.enabled#id": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
        }
        self.ledger = Ledger(spark, self.root, flow, sink)

    def apply(self, events: DataFrame, batch_id: int, rejected: int = 0, stream: str = "") -> bool:
        if self.ledger.done(batch_id, stream):
            return True
        started = time.time()
        counted = Observation()
        rows = append_event_log(events, self.source).observe(counted, F.count(F.lit(1)).alias("n"))
        placed = rows.withColumns({"event_date": F.to_date("timestamp"), "table_dir": table_dir(F.col("table_name"))})
        path = f"{self.root}/events/{self.ledger.place(batch_id, stream)}"
        ordered = placed.sortWithinPartitions("event_date", "table_dir", "timestamp")
        ordered.write.mode("overwrite").options(**self.files).partitionBy("event_date", "table_dir").parquet(path)
        n = counted.get["n"]
        self.ledger.write(batch_id, started, n + rejected, n, True, None, batch_id, rejected, stream)
        return True

    def read(self) -> DataFrame:
        """All logged events; filters on table and day skip folders."""
        return read_or_empty(self.spark, f"{self.root}/events", self.LAYOUT + self.FOLDERS).drop("flow", "sink", "stream")
