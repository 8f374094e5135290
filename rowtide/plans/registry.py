"""Registered queries and their oracle SQL, written on base columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


# The change log of ``logs.change_log`` as columns of the events table.
LOG = """log AS (
  SELECT event_id AS seq, user_id, event_type, ts,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'snapshot'
      WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
    CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'snap'
      WHEN 'error' THEN 'delete' ELSE 'update' END AS action,
    CASE WHEN event_type <> 'view' THEN value END AS val,
    CASE WHEN event_type IN ('click', 'view') THEN CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) END AS k
  FROM events)"""

# Rule of ``logs.dirty_log`` that applies to an event, NULL when none does.
DIRTY = (
    LOG
    + """, dirty AS (
  SELECT *, CASE WHEN seq % 97 = 0 THEN 97 WHEN seq % 89 = 0 THEN 89 WHEN seq % 83 = 0 THEN 83
    WHEN seq % 79 = 0 THEN 79 WHEN seq % 73 = 0 THEN 73 WHEN seq % 71 = 0 THEN 71 END AS rule
  FROM log)
, decoded AS (
  SELECT *, CASE WHEN rule = 83 THEN 'missing_table_name' WHEN rule = 79 THEN 'bad_record'
    WHEN rule = 71 AND op <> 'delete' THEN 'missing_key' END AS violation
  FROM dirty WHERE rule IS NULL OR rule NOT IN (97, 89))
, batched AS (
  SELECT *, CAST((row_number() OVER (ORDER BY seq) - 1) // 100 AS BIGINT) AS batch_id,
    CAST((row_number() OVER (ORDER BY seq) - 1) // 20 AS BIGINT) AS small_batch_id FROM decoded)
"""
)

# Events after the last delete of their key.
LIVE = (
    LOG
    + """, last_delete AS (
  SELECT user_id, max(seq) FILTER (WHERE op = 'delete') AS del_seq FROM log GROUP BY user_id)
, live AS (
  SELECT log.* FROM log JOIN last_delete USING (user_id)
  WHERE op <> 'delete' AND (del_seq IS NULL OR seq > del_seq))
"""
)

UPSERT = f"""WITH {LIVE}
, final AS (
  SELECT user_id AS id, arg_max(event_type, seq) AS event_type,
    arg_max(val, seq) FILTER (WHERE val IS NOT NULL) AS value,
    arg_max(k, seq) FILTER (WHERE k IS NOT NULL) AS k
  FROM live GROUP BY user_id)
"""

# Drift log: the last third of the events brings ``extra``.
DRIFT = (
    LOG
    + """, drift AS (
  SELECT *, CASE WHEN seq * 3 >= 2 * ((SELECT max(event_id) FROM events) + 1) THEN seq END AS extra,
    seq % 10 = 0 AND op = 'update' AS extra_in_changes
  FROM log)
"""
)
