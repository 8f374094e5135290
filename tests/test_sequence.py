"""Range-wise order columns against brute force, with tiny ranges and a hot key."""

import random

from pyspark.sql import functions as F

from rowtide.operators import sequence
from rowtide.operators.sequence import with_position, with_previous, with_run_length


def rows_with_hot_key(n=400, seed=3):
    rng = random.Random(seed)
    numbers = rng.sample(range(5 * n), n)
    rows = [(s, "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", rng.random() < 0.6) for s in numbers]
    return rows


def test_position(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "seq bigint, key string, flag boolean")
    want = {s: i + 1 for i, s in enumerate(sorted(r[0] for r in rows))}
    for bits in (2, 3, 20):
        got = {r.seq: r.position for r in with_position(df, bits=bits).collect()}
        assert got == want


def test_position_per_group(spark):
    rows = rows_with_hot_key() + [(10_000 + i, None, True) for i in range(7)]
    df = spark.createDataFrame(rows, "seq bigint, key string, flag boolean")
    want, seen = {}, {}
    for s, key, _ in sorted(rows, key=lambda r: r[0]):
        seen[key] = seen.get(key, 0) + 1
        want[s] = seen[key]
    got = {r.seq: r.position for r in with_position(df, by=["key"], bits=3).collect()}
    assert got == want


def test_previous(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "seq bigint, key string, flag boolean").withColumn("s", F.col("seq"))
    want, last = {}, {}
    for s, key, _ in sorted(rows):
        want[s] = last.get(key)
        last[key] = s
    for bits in (2, 6, 20):
        got = {r.seq: r.before for r in with_previous(df, "s", ["key"], "before", bits=bits).collect()}
        assert got == want


def test_run_length(spark):
    rows = rows_with_hot_key() + [(9_000 + i, "long", True) for i in range(60)]
    df = spark.createDataFrame(rows, "seq bigint, key string, flag boolean")
    want, run = {}, {}
    for s, key, flag in sorted(rows):
        run[key] = run.get(key, 0) + 1 if flag else 0
        want[s] = run[key]
    for bits in (2, 4, 20):
        got = {r.seq: r.run for r in with_run_length(df, F.col("flag"), ["key"], "run", bits=bits).collect()}
        assert got == want


def sparse_rows(n=600, seed=5):
    """Numbers 2**21 apart, from below zero on, nine tenths of them of one key."""
    rng = random.Random(seed)
    return [((i - 20) * 2**21 + rng.randrange(2**20), "hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", rng.random() < 0.8) for i in range(n)]


def test_ranges_of_ranges(spark, monkeypatch):
    """With sparse numbers every row is a range of its own; the ranges are cut again, over several levels."""
    rows = sparse_rows()
    df = spark.createDataFrame(rows, "seq bigint, key string, flag boolean").withColumn("s", F.when(F.col("flag"), F.col("seq")))
    before, last, runs, run = {}, {}, {}, {}
    for s, key, flag in sorted(rows):
        before[s] = last.get(key)
        last[key] = s if flag else None
        run[key] = run.get(key, 0) + 1 if flag else 0
        runs[s] = run[key]
    for bits, top in ((20, 24), (18, 3)):
        monkeypatch.setattr(sequence, "TOP_BITS", top)
        got = {r.seq: r.before for r in with_previous(df, "s", ["key"], "before", bits=bits).collect()}
        assert got == before
        got = {r.seq: r.run for r in with_run_length(df, F.col("flag"), ["key"], "run", bits=bits).collect()}
        assert got == runs


def test_no_window_over_a_whole_group(spark):
    """Every window is partitioned by a range, but for the two topmost, over what is left of 64 bits."""
    df = spark.createDataFrame(sparse_rows(20), "seq bigint, key string, flag boolean").withColumn("s", F.col("seq"))
    for made in (with_previous(df, "s", ["key"], "before"), with_run_length(df, F.col("flag"), ["key"], "run")):
        windows = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
        assert len(windows) >= 3
        assert sum("__range" not in line.split("], [")[-2] and "__block" not in line.split("], [")[-2] for line in windows) <= 2
