"""Order-dependent columns for groups of any size.

A window over a whole group sorts that group in one task, which fails when one
key holds a large share of the rows. Here every group is cut into ranges of the
arrival sequence. Sequence numbers are distinct integers, so a range of
``2**bits`` numbers never holds more than that many rows: windows run inside
the ranges, and what crosses a range border is one small row for each range.

However far apart the numbers are, no window sees more than ``2**bits`` rows of
a group, but for the topmost: the small rows of the ranges are numbered by
range, so they are cut into ranges of ranges in the same way, and their own
summaries again, until what is left of 64 bits is at most ``TOP_BITS``.
Materialize an input that is costly to compute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.session import materialize

RANGE_BITS = 20
SEQ_BITS = 64
TOP_BITS = 24


def range_of(seq: str | Column, bits: int = RANGE_BITS) -> Column:
    column = F.col(seq) if isinstance(seq, str) else seq
    return F.shiftright(column.cast("bigint"), bits)


def _keyed(df: DataFrame, seq: str, by: Sequence[str], bits: int) -> DataFrame:
    # One struct per group is never NULL, so that groups whose columns are NULL
    # meet in a plain equality join on the partitioning that is already there.
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return df.withColumns({"__range": range_of(seq, bits), "__group": group})


_KEYS = ["__range", "__group"]


def number_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Append the 0-based position of each row in the order of ``keys``, overall.

    Rows are dealt by key ranges and written sorted, so that no task holds more
    than its range; what is added to a row's place in its range is one number
    per range, the only thing that is broadcast.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__row", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.select(*df.columns, (F.col("__row").bitwiseAND((1 << 33) - 1) + F.col("__offset")).alias(name))


def with_position(
    df: DataFrame,
    seq: str = "seq",
    by: Sequence[str] = (),
    name: str = "position",
    bits: int = RANGE_BITS,
) -> DataFrame:
    """Append the 1-based position of each row in sequence order, overall or per ``by``.

    Range sizes are summed in two levels (ranges, then blocks of ranges), so no
    window sees more than ``2**bits`` rows, but for the last one over blocks:
    63-bit numbers make at most ``2**(63 - 2*bits)`` of them.
    """
    ranged = _keyed(df, seq, by, bits)
    local = ranged.withColumn("__local", F.row_number().over(Window.partitionBy(*_KEYS).orderBy(seq)))
    sizes = (
        ranged.groupBy(*_KEYS).agg(F.count("*").alias("__n")).withColumn("__block", range_of("__range", bits))
    )

    def sum_before(column: str, group: list[str], order: str) -> Column:
        earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    in_block = sizes.withColumn("__in_block", sum_before("__n", ["__block", "__group"], "__range"))
    blocks = sizes.groupBy("__block", "__group").agg(F.sum("__n").alias("__block_n"))
    blocks = blocks.select(
        "__block", "__group", sum_before("__block_n", ["__group"], "__block").alias("__before_block")
    )
    offsets = in_block.join(blocks, ["__block", "__group"]).select(
        *_KEYS, (F.col("__in_block") + F.col("__before_block")).alias("__offset")
    )
    placed = local.join(offsets, _KEYS)
    return placed.select(*df.columns, (F.col("__local") + F.col("__offset")).alias(name))


def with_previous(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    name: str,
    seq: str = "seq",
    bits: int = RANGE_BITS,
) -> DataFrame:
    """Append ``value`` of the preceding row of the same group, NULL for the first."""
    return _with_previous(df, value, by, name, seq, bits, SEQ_BITS)


def _with_previous(df: DataFrame, value: str, by: Sequence[str], name: str, seq: str, bits: int, left: int) -> DataFrame:
    """``left`` are the bits that the numbers in ``seq`` may still have."""
    if left <= max(TOP_BITS, bits):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(seq)))
    at, group = f"__range{left}", f"__group{left}"
    ranged = df.withColumns({at: range_of(seq, bits), group: F.struct(*by) if by else F.struct(F.lit(0).alias("all"))})
    in_range = Window.partitionBy(at, group).orderBy(seq)
    local = ranged.withColumn("__prev", F.lag(value).over(in_range)).withColumn("__first", F.row_number().over(in_range) == 1)
    edges = ranged.groupBy(at, group).agg(F.max_by(value, seq).alias("__last"))
    # the last row of the nearest earlier range: the same question about rows that are numbered by range
    carried = _with_previous(edges, "__last", [group], "__carried", at, bits, left - bits)
    carried = carried.where(F.col("__carried").isNotNull()).select(at, group, "__carried")
    joined = local.join(carried, [at, group], "left")
    return joined.select(*df.columns, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__prev")).alias(name))


def with_run_length(
    df: DataFrame,
    in_run: Column,
    by: Sequence[str],
    name: str,
    seq: str = "seq",
    bits: int = RANGE_BITS,
) -> DataFrame:
    """Append how many rows in a row, up to and with this one, satisfy ``in_run``."""
    ranged = _keyed(df, seq, by, bits).withColumn("__in", F.coalesce(in_run, F.lit(False)))
    upto = Window.partitionBy(*_KEYS).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__pos", F.count("*").over(upto))
    # nearest break so far inside the range; 0 while the run came in from before
    local = local.withColumn("__break", F.coalesce(F.max(F.when(~F.col("__in"), F.col("__pos"))).over(upto), F.lit(0)))
    # per range: its rows, and where it was broken last
    edges = local.groupBy(*_KEYS).agg(F.count("*").alias("__n"), F.max("__break").alias("__last_break"))
    edges = _run_before(edges, bits, SEQ_BITS - bits).where(F.col("__carried") > 0).select(*_KEYS, "__carried")
    joined = local.join(edges, _KEYS, "left")
    carried = F.when(F.col("__break") == 0, F.coalesce("__carried", F.lit(0))).otherwise(F.lit(0))
    return joined.select(
        *df.columns, (F.col("__pos") - F.col("__break") + carried).cast("bigint").alias(name)
    )


def _run_before(edges: DataFrame, bits: int, left: int) -> DataFrame:
    """Append ``__carried``, the run that each summary's rows begin with.

    ``edges`` are summaries ``__range, __group, __n, __last_break`` of
    successive rows; two neighbours combine to one of the same form, so blocks
    of them are summaries again.
    """
    whole = left <= max(TOP_BITS, bits)
    blocks = edges.withColumn("__block", F.lit(0).cast("bigint") if whole else range_of("__range", bits))
    earlier = Window.partitionBy("__group", "__block").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    broken = F.when(F.col("__last_break") > 0, F.col("__offset") + F.col("__last_break"))
    placed = placed.withColumn("__at", broken).withColumn("__before", F.max("__at").over(earlier))
    inside = F.col("__offset") - F.coalesce("__before", F.lit(0))
    if whole:
        return placed.select(*edges.columns, inside.alias("__carried"))
    summed = placed.groupBy(F.col("__block").alias("__range"), "__group").agg(
        F.sum("__n").alias("__n"), F.coalesce(F.max("__at"), F.lit(0)).alias("__last_break"))
    entering = _run_before(summed, bits, left - bits).where(F.col("__carried") > 0)
    entering = entering.select(F.col("__range").alias("__block"), "__group", F.col("__carried").alias("__entering"))
    joined = placed.join(entering, ["__block", "__group"], "left")
    came_in = F.when(F.col("__before").isNull(), F.coalesce("__entering", F.lit(0))).otherwise(F.lit(0))
    return joined.select(*edges.columns, (inside + came_in).alias("__carried"))
