"""Batches, metrics and lookups on small tables."""

from pyspark.sql import functions as F

from rowtide.operators import batches, lookup, metrics


def test_batch_sizes(spark):
    for rows in (0, 9, 10, 11, 25):
        df = spark.range(rows).select((F.col("id") * 7 + 3).alias("seq"))
        sizes = batches.count_batches(df, 10, bits=3).groupBy("batch_id").count().orderBy("batch_id").collect()
        assert [r["count"] for r in sizes] == [10] * (rows // 10) + ([rows % 10] if rows % 10 else [])


def test_batch_outcome_reports_earliest(spark):
    rows = [
        (0, 5, None), (0, 6, None),
        (1, 1, "null_key"), (1, 2, None),
        (2, 3, None), (2, 4, "bad_record"),
        (3, 8, "null_key"), (3, 7, "missing_key"), (3, 9, None),
    ]
    df = spark.createDataFrame(rows, "batch_id bigint, seq bigint, violation string")
    got = {r.batch_id: (r.rows, r.bad_rows, r.ok, r.error_seq, r.first_error) for r in batches.batch_outcome(df).collect()}
    assert got == {
        0: (2, 0, True, None, None),
        1: (2, 1, False, 1, "null_key"),
        2: (2, 1, False, 4, "bad_record"),
        3: (3, 2, False, 7, "missing_key"),
    }
    assert sorted(r.seq for r in batches.committed_rows(df).collect()) == [5, 6]
    assert batches.isolated_rows(df).count() == 7


def test_dedup_keeps_earliest_of_a_large_group(spark):
    df = spark.range(600).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("id"),
    )
    got = {r["id"]: r.seq for r in batches.dedup_events(df).collect()}
    want = {}
    for r in df.orderBy("seq").collect():
        want.setdefault(r["id"], r.seq)
    assert got == want


LOG = (
    "flow string, sink string, batch_id bigint, started_at timestamp, ended_at timestamp, rows_in bigint, "
    "rows_rejected bigint, rows_written bigint, ok boolean, error string"
)


def batch_log(spark, marks):
    rows = spark.createDataFrame(
        [("f", "s", i, i, i + 1, 10, 1, 9 if ok else 0, ok, None if ok else f"e{i}") for i, ok in enumerate(marks)],
        LOG.replace("timestamp", "bigint"),
    )
    return rows.withColumns({c: F.timestamp_seconds(c) for c in ("started_at", "ended_at")})


def test_streaks_and_alerts(spark):
    marks = [True] * 3 + [False] * 21 + [True] + [False] * 19 + [True] + [False] * 45
    log = batch_log(spark, marks)
    alerts = metrics.threshold_alerts(log, bits=3).orderBy("batch_id").collect()
    assert [(a.batch_id, a.streak) for a in alerts] == [(22, 20), (64, 20)]
    assert alerts[0].details == "Destination s\nConsecutive errors: 20\nError: e22"
    assert alerts[0].subject == "[CDC Alert] Flow 'f' stopped due to errors"


def test_flow_stats(spark):
    log = batch_log(spark, [True, False, True, False])
    r = metrics.flow_stats(log, now=F.timestamp_seconds(F.lit(3700))).first()
    assert (r.received, r.written, r.rejected, r.errors, r.last_error) == (40, 18, 4, 2, "e3")
    assert (r.uptime_seconds, r.uptime_text) == (3700, "1h 1m")
    since = metrics.flow_stats(log, now=F.timestamp_seconds(F.lit(10)), since=F.timestamp_seconds(F.lit(2))).first()
    assert (since.received, since.errors) == (20, 1)
    two_sinks = log.unionByName(log.withColumn("sink", F.lit("other")))
    assert metrics.flow_received(two_sinks).first().messages_received == 40


def test_flow_references(spark):
    """A used source cannot be removed; once its flow is gone it can."""
    connectors = spark.createDataFrame([("test-source",)], "name string")
    destinations = spark.createDataFrame([("test-sink",)], "name string")
    flows = spark.createDataFrame(
        [("test-flow", "test-source", ["test-sink"])], "flow string, connector_name string, destination_names array<string>"
    )
    assert (connectors.count(), destinations.count(), flows.count()) == (1, 1, 1)
    assert lookup.missing_refs(flows, "connector_name", connectors, "name").count() == 0
    assert lookup.missing_array_refs(flows, "flow", "destination_names", destinations, "name").count() == 0
    doomed = F.col("name") == "test-source"
    kept, refused = lookup.delete_unreferenced(connectors, "name", flows, "connector_name", doomed)
    assert kept.count() == 1 and refused.count() == 1
    used = lookup.references_to(destinations, "name", flows, "destination_names", "flow")
    assert lookup.references_text(used, "name", "flow").first().names == "test-flow"
    kept, refused = lookup.delete_unreferenced(connectors, "name", flows.where("false"), "connector_name", doomed)
    assert kept.count() == 0 and refused.count() == 0


def test_reference_checks(spark):
    parents = spark.createDataFrame([("a",), ("b",)], "name string")
    child = spark.createDataFrame(
        [(1, "a", ["a", "b"]), (2, "x", ["a", "y", "z"]), (3, None, [])], "k bigint, ref string, refs array<string>"
    )
    assert [r.k for r in lookup.missing_refs(child, "ref", parents, "name").collect()] == [2]
    got = sorted((r.k, r.missing or "", r.problem) for r in lookup.missing_array_refs(child, "k", "refs", parents, "name").collect())
    assert got == [(2, "y", "not_found"), (2, "z", "not_found"), (3, "", "empty")]


def test_references_of_any_number_come_in_parts(spark):
    parents = spark.createDataFrame([("a",), ("b",)], "p string")
    child = spark.range(50).select(
        F.when(F.col("id") < 45, "a").otherwise("b").alias("ref"), F.col("id").cast("string").alias("name")
    )
    refs = lookup.references_to(parents, "p", child, "ref", "name")
    assert refs.count() == 50
    parts = sorted((r.p, r.part, r.n_refs, r.names) for r in lookup.references_text(refs, "p", "name", per_part=10).collect())
    names = sorted(str(i) for i in range(45))
    assert parts == [("a", i, 45, ", ".join(names[10 * i : 10 * i + 10])) for i in range(5)] + [("b", 0, 5, "45, 46, 47, 48, 49")]


def test_merges(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v bigint")
    rows = spark.createDataFrame([("b", 9, 0), ("c", 3, 1), ("c", 4, 0)], "name string, v bigint, turn bigint")
    got = sorted(tuple(r) for r in lookup.insert_if_absent(target, rows, "name", order="turn").collect())
    assert got == [("a", 1), ("b", 2), ("c", 4)]
    stamped = target.withColumns({"created_at": F.timestamp_seconds(F.lit(1)), "updated_at": F.timestamp_seconds(F.lit(1))})
    merged = lookup.merge_audited(
        stamped, spark.createDataFrame([("b", None), ("c", 3)], "name string, v bigint"), "name", F.timestamp_seconds(F.lit(5))
    )
    got = sorted(
        (r["name"], r.v, r.c, r.u)
        for r in merged.select("name", "v", F.unix_seconds("created_at").alias("c"), F.unix_seconds("updated_at").alias("u")).collect()
    )
    assert got == [("a", 1, 1, 1), ("b", None, 1, 5), ("c", 3, 5, 5)]
    tied = spark.createDataFrame([("c", 5, 1), ("c", 4, 1), ("d", 8, None), ("d", 7, None), ("e", 1, None), ("e", 2, 3)], rows.schema)
    got = sorted(tuple(r) for r in lookup.insert_if_absent(target, tied, "name", order="turn").collect())
    assert got == [("a", 1), ("b", 2), ("c", 4), ("d", 7), ("e", 2)]
    assert sorted(tuple(r) for r in lookup.insert_if_absent(target, tied.drop("turn"), "name").collect())[2:] == [("c", 4), ("d", 7), ("e", 1)]
    again = lookup.merge_audited(stamped, tied, "name", F.timestamp_seconds(F.lit(5)), order="turn")
    assert sorted((r["name"], r.v) for r in again.collect()) == [("a", 1), ("b", 2), ("c", 5), ("d", 8), ("e", 2)]
    dup = sorted((r["name"], r.n, r.in_target) for r in lookup.duplicate_keys(rows, "name", target).collect())
    assert dup == [("b", 1, True), ("c", 2, False)]
    assert [r["name"] for r in lookup.duplicate_keys(rows, "name").collect()] == ["c"]


def test_newest_of_large_groups(spark):
    """A group is cut to less than twice what is wanted before it is ranked, whatever the order's type and ties."""
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 10 > 0, F.lit(None).cast("int")).otherwise(F.col("id") % 7).alias("g"), (F.col("id") % 1000).alias("tied"))
    rows = rows.withColumn("t", F.timestamp_seconds("id")).withColumn("word", F.lpad(F.col("id").cast("string"), 9, "0"))
    cut = lookup._above_threshold(rows, 500, "id", "g").groupBy("g").count().collect()
    assert all(500 <= r["count"] <= 1_100 + 8 * 180_000 / lookup._ACCURACY for r in cut) and len(cut) == 8
    for order in ("id", "t", "word"):
        kept = lookup.keep_last_n(rows, 500, order, by="g")
        got = {r["g"]: (r["n"], r["low"]) for r in kept.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()}
        groups = {}
        for i in range(200_000):
            groups.setdefault(None if i % 10 else i % 7, []).append(i)
        assert got == {g: (500, ids[-500]) for g, ids in groups.items()}
    tied = lookup.keep_last_n(rows, 500, "tied", by="g").groupBy("g").agg(F.count("*").alias("n"), F.min("tied").alias("low")).collect()
    assert all(r["n"] == 500 for r in tied)
    assert {r["g"]: r["low"] for r in tied}[None] == 997
    few = spark.createDataFrame([(1, None), (1, 5), (1, 7), (2, None)], "g int, v int")
    assert sorted((r.g, r.v) for r in lookup.keep_last_n(few, 2, "v", by="g").where("v IS NOT NULL").collect()) == [(1, 5), (1, 7)]
    assert lookup.keep_last_n(few, 2, "v", by="g").count() == 3


def test_status_and_last_n(spark):
    defs = spark.createDataFrame([("a", "stream"), ("b", "queue")], "name string, type string")
    status = spark.createDataFrame([("a", "Running"), ("x", "Running")], "name string, status string")
    assert [(r["name"], r.active) for r in lookup.status_list(status, defs, "name").collect()] == [("a", True)]
    got = {r["name"]: (r.status, r.active) for r in lookup.status_of(defs, status, "name").collect()}
    assert got == {"a": ("Running", True), "b": ("Stopped", False)}
    typed = lookup.with_type(status, "name", defs, "name", "type")
    assert {r["name"]: r.type for r in typed.collect()} == {"a": "stream", "x": None}
    series = spark.range(100).withColumn("g", F.col("id") % 2)
    assert sorted(r.id for r in lookup.keep_last_n(series, 3, "id").collect()) == [97, 98, 99]
    assert sorted(r.id for r in lookup.keep_last_n(series, 2, "id", by="g").collect()) == [96, 97, 98, 99]
    hot = spark.range(60_000).withColumn("g", F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")))
    kept = lookup.keep_last_n(hot, 10_000, "id", by="g")
    assert kept.where("g = 0").agg(F.count("*"), F.min("id")).first() == (10_000, 60_000 - 11_111)
    tags = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "name string, tags array<string>")
    assert [r["name"] for r in lookup.with_tag(tags, "tags", "y").collect()] == ["a"]
    assert lookup.list_by(defs, "name").first()["name"] == "a"
    assert lookup.get_by(defs, "name", "b").first()["type"] == "queue"


def test_tag_postings_equal_the_scan(spark, tmp_path):
    rows = [(i, ["hot"] + ([f"t{i % 7}"] if i % 3 else []) + (["hot"] if i % 5 == 0 else [])) for i in range(400)]
    rows += [(400, None), (401, []), (402, [None]), (403, [None, "x"]), (404, [""]), (405, ["é 'x'"])]
    df = spark.createDataFrame(rows, "k bigint, tags array<string>")
    postings = lookup.TagPostings(spark, str(tmp_path / "tags"), "k", buckets=4)
    assert postings.with_tag(df, "hot").count() == 0  # nothing posted yet
    postings.insert(df.where("k < 200"), "tags", "a")
    postings.insert(df.where("k >= 200"), "tags", "b")
    postings.insert(df.where("k >= 200"), "tags", "b")  # repeated
    postings.insert(df.where("false"), "tags", "c")
    for tag in ("hot", "t1", "t6", "x", "", "é 'x'", "absent"):
        want = sorted(r.k for r in lookup.with_tag(df, "tags", tag).collect())
        assert sorted(r.k for r in postings.with_tag(df, tag).collect()) == want
        assert postings.keys(tag).count() == len(want)
    plan = postings.keys("t1")._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "bucket" in pruned and "pmod" not in pruned
