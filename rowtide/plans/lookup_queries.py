"""Keyed checks and lookups between tables of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import envelope, lookup
from rowtide.plans import logs
from rowtide.plans.registry import LOG, query
from rowtide.session import work_dir

# All customers under keys moved up; orders of the lowest keys refer to a missing parent.
_PARENTS = "SELECT c_custkey + 40 AS c_custkey, c_name FROM customer"


def _moved_customers(spark, sf_dir):
    customers = logs.table(spark, sf_dir, "customer")
    return customers.select((F.col("c_custkey") + 40).alias("c_custkey"), "c_name")


@query(
    f"""SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM ({_PARENTS}) p WHERE p.c_custkey = o_custkey)"""
)
def missing_refs(spark, sf_dir):
    orders = logs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookup.missing_refs(orders, "o_custkey", _moved_customers(spark, sf_dir), "c_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query(
    """WITH child AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 7 THEN []
    WHEN o_orderkey % 50 = 0 THEN [o_orderkey % 10, o_custkey % 10, 1000000000 + o_orderkey]
    ELSE [o_orderkey % 10, o_custkey % 10] END AS suppliers FROM orders)
, refs AS (SELECT o_orderkey, unnest(suppliers) AS missing FROM child)
SELECT o_orderkey, missing, 'not_found' AS problem FROM refs
WHERE missing NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT o_orderkey, NULL, 'empty' FROM child WHERE len(suppliers) = 0"""
)
def missing_array_refs(spark, sf_dir):
    key = F.col("o_orderkey")
    known = [key % 10, F.col("o_custkey") % 10]
    suppliers = (
        F.when(key % 40 == 7, F.array().cast("array<bigint>"))
        .when(key % 50 == 0, F.array(*known, F.lit(1000000000) + key))
        .otherwise(F.array(*known))
    )
    child = logs.table(spark, sf_dir, "orders").select("o_orderkey", suppliers.alias("suppliers"))
    return lookup.missing_array_refs(
        child, "o_orderkey", "suppliers", logs.table(spark, sf_dir, "supplier"), "s_suppkey"
    )


def _supplier_references(spark, sf_dir):
    # nations under moved keys: what refers to the lowest ones finds no parent
    nations = logs.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3).alias("n_nationkey"))
    suppliers = logs.table(spark, sf_dir, "supplier").select(
        F.array("s_nationkey", (F.col("s_nationkey") + 1) % 25).alias("nations"), "s_name"
    )
    return lookup.references_to(nations, "n_nationkey", suppliers, "nations", "s_name")


_REFERENCES = """moved AS (SELECT n_nationkey + 3 AS n_nationkey FROM nation)
, refs AS (
  SELECT DISTINCT n_nationkey, s_name FROM moved
  JOIN supplier ON n_nationkey = s_nationkey OR n_nationkey = (s_nationkey + 1) % 25)"""


@query(f"WITH {_REFERENCES} SELECT n_nationkey, s_name FROM refs")
def references_to(spark, sf_dir):
    return _supplier_references(spark, sf_dir)


@query(
    f"""WITH {_REFERENCES}
, placed AS (SELECT n_nationkey, s_name, count(*) OVER (PARTITION BY n_nationkey) AS n_refs,
    CAST((row_number() OVER (PARTITION BY n_nationkey ORDER BY s_name) - 1) // 3 AS BIGINT) AS part FROM refs)
SELECT n_nationkey, part, n_refs, string_agg(s_name, ', ' ORDER BY s_name) AS names
FROM placed GROUP BY n_nationkey, part, n_refs"""
)
def references_text(spark, sf_dir):
    return lookup.references_text(_supplier_references(spark, sf_dir), "n_nationkey", "s_name", per_part=3)


@query(
    """WITH used AS (SELECT l_partkey * 2 AS k FROM lineitem)
SELECT p_partkey, 'kept' AS outcome FROM part WHERE p_size <= 25
UNION ALL SELECT p_partkey, 'kept' FROM part WHERE p_size > 25 AND p_partkey IN (SELECT k FROM used)
UNION ALL SELECT p_partkey, 'refused' FROM part WHERE p_size > 25 AND p_partkey IN (SELECT k FROM used)"""
)
def delete_unreferenced(spark, sf_dir):
    parts = logs.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # doubled keys leave odd parts without a reference
    lines = logs.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("l_partkey"))
    kept, refused = lookup.delete_unreferenced(parts, "p_partkey", lines, "l_partkey", F.col("p_size") > 25)
    return kept.select("p_partkey", F.lit("kept").alias("outcome")).unionByName(
        refused.select("p_partkey", F.lit("refused").alias("outcome"))
    )


@query(
    """SELECT p_name, count(*) AS n, p_name IN (SELECT p_name FROM part WHERE p_size = 1) AS in_target
FROM part WHERE p_size > 1 GROUP BY p_name
HAVING count(*) > 1 OR p_name IN (SELECT p_name FROM part WHERE p_size = 1)"""
)
def duplicate_keys(spark, sf_dir):
    parts = logs.table(spark, sf_dir, "part").select("p_name", "p_size")
    rows, target = parts.where(F.col("p_size") > 1), parts.where(F.col("p_size") == 1)
    return lookup.duplicate_keys(rows, "p_name", target)


@query("SELECT c_name, c_custkey FROM customer ORDER BY c_name")
def list_by_name(spark, sf_dir):
    return lookup.list_by(logs.table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name")


@query("SELECT c_name, c_custkey FROM customer WHERE c_name = 'Customer#000000042'")
def get_by_name(spark, sf_dir):
    customers = logs.table(spark, sf_dir, "customer").select("c_name", "c_custkey")
    return lookup.get_by(customers, "c_name", "Customer#000000042")


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'Running' WHEN 'P' THEN 'Paused' ELSE 'Failed' END"


def _order_status(spark, sf_dir):
    status = (
        F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "P", "Paused").otherwise("Failed")
    )
    return logs.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), status.alias("status"))


@query(
    f"""SELECT o_orderkey, p.c_custkey, {_STATUS} AS status, c_name, {_STATUS} = 'Running' AS active
FROM orders JOIN ({_PARENTS}) p ON p.c_custkey = o_custkey"""
)
def status_list(spark, sf_dir):
    return lookup.status_list(_order_status(spark, sf_dir), _moved_customers(spark, sf_dir), "c_custkey")


@query(
    """WITH s AS (SELECT o_custkey + 40 AS k, CASE WHEN max(CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END) = 1 THEN 'Running' ELSE 'Paused' END AS status
  FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, coalesce(status, 'Stopped') AS status, coalesce(status, 'Stopped') = 'Running' AS active
FROM customer LEFT JOIN s ON k = c_custkey"""
)
def status_default(spark, sf_dir):
    orders = logs.table(spark, sf_dir, "orders")
    open_orders = F.max(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0))
    status = orders.groupBy((F.col("o_custkey") + 40).alias("c_custkey")).agg(
        F.when(open_orders == 1, "Running").otherwise("Paused").alias("status")
    )
    definitions = logs.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lookup.status_of(definitions, status, "c_custkey")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_type
FROM lineitem LEFT JOIN (SELECT p_partkey + 50 AS k, p_type FROM part) ON k = l_partkey"""
)
def with_type(spark, sf_dir):
    lines = logs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    parts = logs.table(spark, sf_dir, "part").select((F.col("p_partkey") + 50).alias("p_partkey"), "p_type")
    return lookup.with_type(lines, "l_partkey", parts, "p_partkey", "p_type").select(*lines.columns, "p_type")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' OR source = 'en'")
def with_tag(spark, sf_dir):
    documents = logs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    tagged = documents.withColumn("tags", F.array("lang", "source"))
    return lookup.with_tag(tagged, "tags", "en").drop("tags")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' OR source = 'en'")
def with_tag_postings(spark, sf_dir):
    """The same by an inverted index that two inserts built."""
    documents = logs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    postings = lookup.TagPostings(spark, work_dir(spark, "tags"), "doc_id", buckets=8)
    tagged = documents.select("doc_id", F.array("lang", "source").alias("tags"))
    is_late = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    for name, rows in (("first", tagged.where(~is_late)), ("second", tagged.where(is_late))):
        postings.insert(rows, "tags", name)
    return postings.with_tag(documents, "en")


def _event_log(spark, sf_dir):
    routed = envelope.with_route(logs.good_events(logs.change_log(spark, sf_dir)))
    return lookup.append_event_log(routed, "events")


@query(
    f"""WITH {LOG}
SELECT epoch_us(ts) AS ts_micros, 'events' AS source, 'users' AS table_name, op AS operation, user_id AS data_id
FROM log WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND op = 'update'"""
)
def event_log_filter(spark, sf_dir):
    def instant(text):
        return F.lit(text).cast("timestamp")

    found = lookup.event_log(
        _event_log(spark, sf_dir),
        since=instant("2024-01-10 00:00:00"),
        until=instant("2024-01-20 00:00:00"),
        source="events",
        table="users",
        operation="update",
    )
    return found.select(
        F.unix_micros("timestamp").alias("ts_micros"),
        "source",
        "table_name",
        "operation",
        F.get_json_object("data", "$.id").cast("bigint").alias("data_id"),
    )
