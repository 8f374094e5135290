"""Exact top-k inner-product search by a pivot-distance index.

Every vector gets one more component that makes all of them equally long, so
that the largest inner products are the smallest distances. It is keyed by its
nearest pivot and its distance to that pivot, and the keys are sorted: a run of
consecutive keys is a set of annuli around pivots, here called a tile. By the
triangle inequality a query whose distance to the pivot is ``d`` finds nothing
nearer than ``max(d - high, low - d)`` in an annulus from ``low`` to ``high``.
Each query visits the tiles in the order of that bound, one at first and eight
times as many in each further round, and stops when the bound of its next tile
cannot reach the k-th score it has. Within a tile the scores are products of two
matrices. The search is exact; only the pivots are fitted, on a sample.

A tile holds at most ``TILE`` vectors, or as many more as keep the number of
tiles at ``MAX_TILES``; their list is all that every task gets. A task sees one
tile and at most about ``QUERIES_AT_ONCE`` queries, whatever is how frequent.

Defined results: vectors null, with a null or non-finite component, or without
an id take no part. Vectors of unequal lengths are compared as if the shorter
one ended in zeros; an empty vector scores 0 with every other. Rows are
candidates one by one: a repeated id or vector counts as often as it is there,
and only the query's own row is left out of its answer, so a repeated query id
gets an answer for each of its rows. Components and scores beyond a 64-bit
number stay at its ends. No query or no other row: no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.llm.common import prepare, with_position
from rowtide.session import materialize

PIVOTS = 64
SAMPLE = 16_384  # vectors the pivots are fitted on, about
TILE = 8_192
MAX_TILES = 16_384
QUERIES_AT_ONCE = 4_096
WIDEN = 8  # a round visits so many times the tiles of all rounds before
LEAST = -(1 << 63)


def quantized(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of every component, null for a vector that takes no part."""
    values = vector.cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(values.isNotNull() & ~bad, F.transform(values, lambda x: F.floor(F.lit(scale) * x)))


@dataclass
class Space:
    """What all tasks share: bounded by the numbers of pivots and tiles."""

    dims: int
    kind: str  # stored components
    exact: str  # what products are computed in: f4 or f8 where every sum is exact, else Python's integers
    length: float
    pivots: np.ndarray | None = None
    tiles: np.ndarray | None = None  # of each annulus, ascending
    around: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def matrix(self, packed: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(packed.to_pylist()), dtype=self.kind).reshape(len(packed), self.dims)

    def distances(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """To every pivot; what a candidate lacks in length is its last component, a query's is 0."""
        x = vectors.astype("f8")
        squares = (x * x).sum(axis=1)
        last = np.zeros(len(x)) if queries else np.sqrt(np.maximum(self.length**2 - squares, 0))
        x = np.column_stack((x, last))
        gap = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(gap, 0))

    @property
    def slack(self) -> float:
        """More than what rounding may add to a distance."""
        return 1e-7 * np.sqrt(self.dims + 4) * max(self.length, 1.0)

    def scores(self, queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        if self.exact != "O":
            return queries.astype(self.exact) @ candidates.astype(self.exact).T
        whole = queries.astype(object) @ candidates.astype(object).T
        return np.clip(whole, LEAST, (1 << 63) - 1).astype(np.int64)

    def visits(self, queries: np.ndarray, floor: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Query numbers and tiles ``start`` to ``stop`` of each one's order, of those that may reach ``floor``."""
        d = self.distances(queries, queries=True)[:, self.around]
        bound = np.maximum(np.maximum(d - self.high, self.low - d) - self.slack, 0)
        first = np.flatnonzero(np.append(True, self.tiles[1:] != self.tiles[:-1]))
        bound, near = np.minimum.reduceat(bound, first, axis=1), np.minimum.reduceat(d, first, axis=1)
        order = np.lexsort((near, bound), axis=-1)[:, start:stop]
        squares = (queries.astype("f8") ** 2).sum(axis=1) + self.length**2
        reach = squares[:, None] - np.take_along_axis(bound, order, axis=1) ** 2
        i, j = np.nonzero(reach >= 2 * floor.astype("f8")[:, None])
        return i, self.tiles[first][order[i, j]]


def fit_pivots(sample: np.ndarray, count: int, steps: int = 8) -> np.ndarray:
    """Centres of a sample by Lloyd's steps, from spread beginnings."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(steps):
        nearest = ((centres**2).sum(axis=1) - 2 * (sample @ centres.T)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        n = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def build_index(vectors: DataFrame, vec_id: str, vector: str, scale: float, pivots: int = PIVOTS, tile: int = TILE) -> tuple[DataFrame, Space | None]:
    """``row, vec_id, packed, pivot, dist, tile``, sorted by key and written, and what tasks need to search it."""
    spark = prepare(vectors.sparkSession)
    whole = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), quantized(F.col(vector), scale).alias("q"))
    whole = materialize(whole.where("vec_id IS NOT NULL AND q IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors")
    squares = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))
    stats = whole.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.max(largest).alias("top"), F.max(squares).alias("squares")).first()
    if not stats["n"]:
        return whole, None
    dims, top = max(stats["dims"], 1), stats["top"] or 0.0
    kind = next((k for k, limit in (("i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if top < limit), "<i8")
    exact = "f4" if dims * top * top < 2**24 else "f8" if dims * top * top < 2**53 else "O"
    space = Space(dims, kind, exact, float(np.sqrt(stats["squares"] or 0.0)))
    share = SAMPLE / stats["n"]
    drawn = whole if share >= 1 else whole.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = _padded(drawn.select("q").toArrow().column(0).combine_chunks(), dims).astype("f8")  # about SAMPLE rows
    last = np.sqrt(np.maximum(space.length**2 - (sample**2).sum(axis=1), 0))
    space.pivots = fit_pivots(np.column_stack((sample, last)), pivots)
    shipped = spark.sparkContext.broadcast(space)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shipped.value
        for batch in batches:
            if batch.num_rows:
                q = _padded(batch.column(2), space.dims)
                d = space.distances(q, queries=False)
                nearest = d.argmin(axis=1)
                packed = [x.tobytes() for x in q.astype(space.kind)]
                columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(nearest.astype("i4")), pa.array(d[np.arange(len(q)), nearest])]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "packed", "pivot", "dist"])

    keys = whole.select("row", "vec_id", "q").mapInArrow(keyed, "row bigint, vec_id bigint, packed binary, pivot int, dist double")
    placed, _ = with_position(keys, ["pivot", "dist", "row"], "position", "index")
    width = max(tile, -(-stats["n"] // MAX_TILES))
    index = materialize(placed.withColumn("tile", F.floor(F.col("position") / width).cast("bigint")).drop("position"), "tiles")
    annuli = index.groupBy("tile", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("tile", "pivot").toArrow()
    space.tiles, space.around, space.low, space.high = (annuli.column(c).to_numpy() for c in ("tile", "pivot", "low", "high"))
    return index, space


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", "found_row")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


_FOUND = "row bigint, query_id bigint, vec_id bigint, found_row bigint, score bigint"


def search(index: DataFrame, space: Space, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of the index for each row of ``queries``, rows of it too."""
    spark = prepare(index.sparkSession)
    queries = materialize(queries.select("row", "vec_id", "packed"), "queries")
    chunks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    shipped = spark.sparkContext.broadcast(space)
    n_tiles = len(np.unique(space.tiles))

    def visiting(start: int, stop: int):
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    floor = batch.column(3).to_numpy(zero_copy_only=False)
                    i, tiles = shipped.value.visits(shipped.value.matrix(batch.column(2)), floor, start, stop)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns), pa.array(tiles)], names=["row", "vec_id", "packed", "floor", "tile"])

        return visit

    def score(asked: pa.Table, there: pa.Table) -> pa.Table:
        space = shipped.value
        row, query_id, floor = (asked.column(c).to_numpy() for c in ("row", "vec_id", "floor"))
        found_row, vec_id = (there.column(c).to_numpy() for c in ("row", "vec_id"))
        q, c = space.matrix(asked.column("packed")), space.matrix(there.column("packed"))
        parts = [(np.zeros(0, dtype=np.int64),) * 3]
        for a in range(0, len(q), 512):
            for b in range(0, len(c), TILE):
                s = space.scores(q[a : a + 512], c[b : b + TILE])
                least = floor[a : a + 512].astype(s.dtype)
                if s.shape[1] > k + 1:  # one more, as one may be the query itself
                    least = np.maximum(least, np.partition(s, s.shape[1] - k - 1, axis=1)[:, -k - 1])
                i, j = np.nonzero(s >= least[:, None])
                parts.append((i + a, j + b, s[i, j].astype(np.int64)))
        i, j, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        other = row[i] != found_row[j]
        i, j, s = i[other], j[other], s[other]
        order = np.lexsort((found_row[j], vec_id[j], ~s, i))
        i, j, s = i[order], j[order], s[order]
        begins = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: i.size])
        place = np.arange(i.size) - np.repeat(begins, np.diff(np.append(begins, i.size)))
        i, j, s = i[place < k], j[place < k], s[place < k]
        return pa.table([row[i], query_id[i], vec_id[j], found_row[j], s], names=["row", "query_id", "vec_id", "found_row", "score"])

    best, start, stop = None, 0, 1
    while start < n_tiles:
        asked = queries.withColumn("floor", F.lit(LEAST))
        if best is not None:
            reached = best.groupBy(F.col("row").alias("asked")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
            asked = queries.join(reached, F.col("row") == F.col("asked"), "left").select(
                *queries.columns, F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(LEAST)).alias("floor"))
        visits = asked.mapInArrow(visiting(start, stop), "row bigint, vec_id bigint, packed binary, floor bigint, tile bigint")
        visits = materialize(visits.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks))), "visits")
        units = visits.select(F.col("tile").alias("asked_tile"), F.col("chunk").alias("asked_chunk")).distinct()
        there = index.select("row", "vec_id", "packed", "tile").join(units, F.col("tile") == F.col("asked_tile"))
        found = visits.groupBy("tile", "chunk").cogroup(there.groupBy("asked_tile", "asked_chunk")).applyInArrow(score, _FOUND)
        found = found if best is None else found.unionByName(best.select(*found.columns))
        best, start, stop = materialize(_best(found, k), "best"), stop, stop * WIDEN
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding", **sizes) -> DataFrame:
    """The ``k`` largest inner products of each row for which ``is_query`` (over ``vec_id``) holds, with all other rows."""
    index, space = build_index(vectors, vec_id, vector, scale, **sizes)
    if space is None:
        return index.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("row").alias("score"))
    return search(index, space, index.where(is_query), k)
