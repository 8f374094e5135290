"""Sharding along a Hilbert curve over several metadata columns.

Every metadata column is quantised into equally filled cells, the cells' place
on the Hilbert curve is the sort key, and the sorted rows are cut into runs of
equal counts. Rows of a run lie close together in every column, so the minimum
and maximum a file keeps of each column prune files for filters on any of them.

Only DataFrame functions are used. Cell borders are at most ``2**bits - 2``
values per column; text columns are quantised on the seven bytes after the
prefix that all values share. Ties on the curve are broken by a hash of the
row, which also splits a cell that holds a third of all rows over many tasks.

Defined results: nulls have a cell of their own, before all others. The law is
``rows``: shard sizes differ by at most one. Equal rows are interchangeable and
each gets its own slot. Shards beyond the number of rows stay empty; an empty
table gives no rows. Only ``doc_id``, ``text`` and the metadata columns are
read, under the operator's own names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from rowtide.llm.common import prepare, with_position

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5
PROXY_BYTES = 7


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve of integer coordinates below ``2**bits``.

    Skilling's transform: undo the rotations bit by bit from the top, Gray
    encode, interleave. The coordinates travel through one fold, so the
    expression's size does not grow with the number of steps.
    """
    n = len(cells)
    if n * bits > 62:
        raise ValueError("the index must fit into 62 bits")

    def rotate(x: Column, step: Column) -> Column:
        i = (step % n).cast("int")
        q = F.call_function("shiftleft", F.lit(1), (F.lit(bits - 1) - (step / n).cast("int")).cast("int"))
        x0, xi = F.get(x, F.lit(0)), F.get(x, i)
        swap = x0.bitwiseXOR(xi).bitwiseAND(q - 1)
        is_set = xi.bitwiseAND(q) != 0
        head = F.when(is_set, x0.bitwiseXOR(q - 1)).otherwise(x0.bitwiseXOR(swap))
        at = F.when(is_set, xi).otherwise(xi.bitwiseXOR(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, head).when(j == i, at).otherwise(v))

    axes = F.array(*[c.cast("int") for c in cells])
    if bits > 1:
        axes = F.reduce(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), axes, rotate)
    empty = F.array().cast("array<int>")
    gray = F.reduce(axes, empty, lambda acc, v: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)).bitwiseXOR(v)))

    def interleave(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        flip = F.lit(0)
        for s in range(1, bits):
            flip = flip.bitwiseXOR(F.shiftright(last, s))
        turned = F.transform(x, lambda v: v.bitwiseXOR(flip))
        digit = lambda acc, v: acc * 2 + v
        bits_of = lambda b: F.transform(turned, lambda v: F.call_function("shiftright", v, b).bitwiseAND(F.lit(1)))
        return F.reduce(
            F.flatten(F.transform(F.sequence(F.lit(bits - 1), F.lit(0)), bits_of)), F.lit(0).cast("bigint"), digit
        )

    return F.get(F.transform(F.array(gray), interleave), F.lit(0))


def _proxies(docs: DataFrame, dimensions: Sequence[str]) -> list[Column]:
    """A number per column in the column's order; null stays null."""
    fields = {f.name: f.dataType for f in docs.schema.fields}
    texts = [d for d in dimensions if not isinstance(fields[d], NumericType)]
    shared = {}
    if texts:
        as_hex = {d: F.hex(F.col(f"`{d}`").cast("string").cast("binary")) for d in texts}
        ends = docs.select([f(as_hex[d]).alias(f"{k}{i}") for i, d in enumerate(texts) for k, f in (("a", F.min), ("b", F.max))]).first()
        for i, d in enumerate(texts):
            low, high = ends[f"a{i}"] or "", ends[f"b{i}"] or ""
            same = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
            shared[d] = same // 2 * 2
    out = []
    for d in dimensions:
        column = F.col(f"`{d}`")
        if d in shared:
            part = F.rpad(F.substring(as_hex[d], shared[d] + 1, 2 * PROXY_BYTES), 2 * PROXY_BYTES, "0")
            out.append(F.conv(part, 16, 10).cast("double"))
        else:
            out.append(column.cast("double"))
    return out


def _cells(proxied: DataFrame, names: Sequence[str], bits: int) -> list[Column]:
    fractions = [i / (2**bits - 1) for i in range(1, 2**bits - 1)]
    borders = proxied.agg(*[F.percentile_approx(c, fractions, 10000).alias(c) for c in names]).first()
    cells = []
    for c in names:
        cuts = sorted(set(borders[c] or []))
        cells.append(F.when(F.col(c).isNull() | F.isnan(c), F.lit(0)).otherwise(_above(cuts, F.col(c)) + 1))
    return cells


def _above(cuts: list[float], value: Column) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda cut: cut < value)) if cuts else F.lit(0)


def curve_rows(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, carry: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, curve, tie`` per row, with ``carry`` also the whole ``row``."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    names = [f"d{i}" for i in range(len(dimensions))]
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    proxies = [p.alias(n) for p, n in zip(_proxies(docs, dimensions), names, strict=True)]
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *proxies,
        *whole,
    )
    cells = _cells(docs.select(*proxies), names, bits)
    return rows.select(
        "doc_id", "size", "text_crc32", hilbert_index(cells, bits).alias("curve"), F.xxhash64("doc_id", "text_crc32").alias("tie"),
        *(["row"] if carry else []),
    )


def shard(docs: DataFrame, shards: int = 8, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, carry: bool = False) -> DataFrame:
    """Append to ``curve_rows``: ``shard`` and ``slot``, the gapless place within it along the curve."""
    curve = curve_rows(docs, dimensions, bits, carry)
    placed, sizes = with_position(curve, ["curve", "tie", "doc_id", "text_crc32", "size"], "position", "curve")
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    base, extra = divmod(total, shards)
    long_rows = extra * (base + 1)
    p = F.col("position")
    number = F.when(p < long_rows, F.floor(p / (base + 1))).otherwise(extra + F.floor((p - long_rows) / max(base, 1)))
    start = F.least(F.col("shard"), F.lit(extra)) * (base + 1) + F.greatest(F.col("shard") - extra, F.lit(0)) * base
    return placed.withColumn("shard", number.cast("int")).withColumn("slot", (p - start).cast("bigint")).drop("position")


def write_shards(docs: DataFrame, path: str, shards: int = 8, files_per_shard: int = 8, **options) -> None:
    """Write whole rows, one folder per shard, each file a run of the curve."""
    sharded = shard(docs, shards, carry=True, **options)
    runs = sharded.repartitionByRange(shards * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot")
    runs.select("row.*", F.col("shard").alias("__shard")).write.partitionBy("__shard").parquet(path)
