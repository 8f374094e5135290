"""What several operators share: reading documents, positions in a global order, filters that keep rows whole."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowtide.session import configure, materialize

# Rows handed to Python at a time; bounds a worker's memory when texts are long.
ARROW_ROWS = 500
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # Also for tables that are not huge: a Bloom filter of one side's keys before the other side is shuffled.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "10m")
    # Python workers find this package where the driver does; where executors see no such folder, ship it by --py-files.
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone, a null text as the empty one; no other column can clash with an operator's own."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def held_out(remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` on division by five; an id of null is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def with_position(df: DataFrame, keys: Sequence[str], name: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Append the 0-based position in the order of ``keys``; also return the sizes of the sorted pieces.

    Rows are dealt by key ranges, sorted within them and written, so that no
    task holds more than its range. Positions within a range come from row
    numbers of the sorted partition; what is added to them is one row per
    partition, the only thing that is broadcast. Keys must tell all rows apart
    that differ.
    """
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(sorted_rows.withColumn("__row", F.monotonically_increasing_id()), label)
    part = F.shiftright("__row", 33).alias("__part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    position = F.col("__row").bitwiseAND((1 << 33) - 1) + F.col("__offset")
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.select(*df.columns, position.alias(name)), sizes


def where_row(docs: DataFrame, keep: Column) -> DataFrame:
    """Rows of ``docs`` for which ``keep`` holds, every column as it was."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), keep.alias("keep"))
    return whole.where("keep").select("row.*")


# --- hashed words ----------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RADIX = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_RADIX))
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_BYTES_AT_ONCE = 1 << 18
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, and the offsets of its rows in them."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, and each row's offsets in them.

    Words never reach over a row's end. ``lower`` takes A-Z as a-z. Rows are
    handled some at a time, which keeps the arrays in the processor's cache.
    """
    hashes, counts, row = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], 0
    while row < len(ends) - 1:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + _BYTES_AT_ONCE, side="right")) - 1)
        part, per_row = _hash_rows(data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row], lower)
        hashes.append(part)
        counts.append(np.diff(per_row))
        row = stop
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def _hash_rows(data: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_IS_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < data.size]
    starts[first] = inside[first]
    per_row = np.concatenate(([0], np.cumsum(starts)))[ends]
    letters = data[inside]
    if letters.size == 0:
        return np.zeros(0, dtype=np.uint64), per_row
    begins = np.flatnonzero(starts[inside])
    lengths = np.diff(np.append(begins, letters.size))
    place = np.arange(letters.size, dtype=np.int32) - np.repeat(begins.astype(np.int32), lengths)
    powers = np.full(int(lengths.max()), _RADIX, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mix(np.add.reduceat(_VALUES[lower][letters] * powers[place], begins)), per_row


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; of the whole sequence when there are fewer; of nothing for none."""
    if len(words) == 0:
        return words
    width = min(k, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = (out + words[i : i + len(out)]) * np.uint64(_RADIX + 2 * i)
    return mix(out ^ np.uint64(width))
