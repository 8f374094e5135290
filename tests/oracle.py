"""Side-by-side comparison of a registered query with its oracle SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("n", "nan" if math.isnan(value) else round(value, 9))
    if isinstance(value, int):
        return ("n", float(value) if abs(value) < 2**53 else value)
    return (type(value).__name__, str(value))


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=repr
    )


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def compare(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    got_columns, got = rows_by_name(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want_columns, want = rows_by_name(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    odd = {n: (t, types[n]) for n, t in df.dtypes if KINDS.get(t) != types[n]}
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 30000 else got[:2]
        lacking = [r for r in want if r not in got][:3] if len(got) < 30000 else want[:2]
        return f"{len(got)} rows != {len(want)} rows; only here {extra}; only oracle {lacking}; types {odd}"
    if odd:
        return f"types differ: {odd}"
    if not want:
        return "both are empty"
    return None
