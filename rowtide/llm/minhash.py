"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with equal sets are one
class. In each of several independent trees a class walks down from the root:
a hash of the path so far selects one minhash coordinate, now and then two, and
the class goes to the child named by its own value there. Two classes of the
wanted similarity share each selected coordinate with that probability, so the
number of their common paths stays 1 on average at every depth, while unlike
classes part at once. Nodes with few classes are compared exhaustively; larger
ones, and they alone, branch on. A pair is a link only when the full sets confirm it.

A node first compares the minhashes, after the sets' sizes. Each class names one
likely partner, of the surest ones that of the smallest name, which a crowd of
near copies has in common; the full sets confirm these pairs. Where a node then
still has likely pairs of two components, it gets the sets of their classes,
and one task finds every link between them by the sizes of all intersections,
and passes on only what joins components. So no link between components is
lost, and a crowd does not emit its pairs. A node that still is large at the last level holds a crowd. Its class that
is in most such nodes is the hub, as what a crowd's members are copies of is in
nearly all; nodes with one hub, mostly of several trees, are taken together, so
that a crowd is compared once and not in every tree. They are cut into pieces
that all contain the hub, which joins the crowd. Where classes of other
components are left, they are then compared with every piece.

With the defaults a pair at the threshold is missed by all trees with a
probability below 1e-5 at four levels, a more similar pair far less often.
Everything moves in joins and aggregates on rows of a few numbers; texts are
shuffled once, to fetch the sets that confirm links.

Trees are walked in two rounds. The first few join what is plainly alike; the
others then leave out nodes whose classes are one component already, and look
at no pairs within one. Few links are left for them, so they name no likely
partners first but go to the sets at once. What is still large after the first
round is left to the second.

Defined results: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; with
fewer words than a shingle has, the whole sequence is the one shingle. A null
text or one without words has no set, is linked with nothing and stays. A row
without an id is its own group and stays. Repeated rows are one class; rows
that share the group's smallest id all count as kept, of equal ones
``drop_near_duplicates`` leaves one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from rowtide.llm.common import buffers, id_and_text, mix, prepare, shingle_hashes, word_hashes
from rowtide.session import materialize

WORDS = 5
SIMILARITY = 80  # hundredths
TREES = 16
COORDINATES = 128
SECOND_BRANCH = 0.25  # branches a level: 1 + this = 1 / similarity
SMALL_NODE = 1024
TARGET_NODE = 64  # unlike classes a node should hold at the first level that is looked at
DEEPER_LEVELS = 2
FIRST_TREES = 2  # of the first round, which goes down FIRST_LEVELS only
FIRST_LEVELS = 2
COLUMNS_AT_ONCE = 1 << 13
SETS_AT_ONCE = 1024

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
_XOR, _ODD = _SEEDS[:COORDINATES, None], _SEEDS[COORDINATES:, None] | np.uint64(1)


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of ``COORDINATES`` permutations, as 16-bit numbers."""
    least = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), SETS_AT_ONCE):
        np.minimum(least, ((hashes[at : at + SETS_AT_ONCE] ^ _XOR) * _ODD).min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype("<u2")


def _row_key():
    return F.xxhash64("doc_id", F.xxhash64("text"))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("sig", pa.binary())])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, key, n_shingles, cls, sig``: the set's size, its 64-bit name and its minhashes; null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, ends = word_hashes(*buffers(batch.column(2)), lower=True)
            sizes, names, sigs = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                shingles = np.unique(shingle_hashes(hashed[a:b], words))
                sizes.append(len(shingles))
                name = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
                names.append(int.from_bytes(name, "little", signed=True) if len(shingles) else None)
                sigs.append(minhashes(shingles).tobytes() if len(shingles) else None)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SIGNED)

    rows = id_and_text(docs).select("doc_id", _row_key().alias("key"), "text")
    return rows.mapInArrow(sign, "doc_id bigint, key bigint, n_shingles bigint, cls bigint, sig binary")


def walk(sigs: np.ndarray, trees: range, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and nodes at ``depth`` of every chosen path."""
    rows = np.tile(np.arange(len(sigs)), len(trees))
    paths = np.repeat(mix(np.array(trees, dtype=np.uint64) + np.uint64(0x5EED)), len(sigs))
    for _ in range(depth):
        rows, paths = branch(sigs, rows, paths)
    return rows, paths


def branch(sigs: np.ndarray, rows: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and nodes one level below the nodes ``paths`` of ``rows``."""
    draw = mix(paths ^ np.uint64(0xC0FFEE))
    first = (draw % np.uint64(COORDINATES)).astype(np.int64)
    twice = np.flatnonzero(mix(paths ^ np.uint64(0xBEEF)) < np.uint64(int(SECOND_BRANCH * 2**64)))
    other = (first[twice] + 1 + (draw[twice] >> np.uint64(32)).astype(np.int64) % (COORDINATES - 1)) % COORDINATES
    rows, paths, at = np.append(rows, rows[twice]), np.append(paths, paths[twice]), np.append(first, other)
    return rows, mix(mix(paths) ^ (at.astype(np.uint64) << np.uint64(16) | sigs[rows, at].astype(np.uint64)))


def nodes(classes: DataFrame, trees: range, depth: int) -> DataFrame:
    """``node, cls`` of every path at ``depth``."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.column(0).to_numpy()
            rows, paths = walk(_sigs(batch.column(1)), trees, depth)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(names[rows])], names=["node", "cls"])

    # A path may reach a node twice by taking one coordinate twice; such rows are equal and do no harm.
    return classes.select("cls", "sig").mapInArrow(walked, "node bigint, cls bigint")


def children(classes: DataFrame, stuck: DataFrame) -> DataFrame:
    """``node, cls`` one level below the rows ``node, cls`` of ``stuck``."""

    def branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names, above = batch.column(0).to_numpy(), batch.column(2)
            rows = np.repeat(np.arange(len(names)), above.value_lengths().to_numpy())
            rows, paths = branch(_sigs(batch.column(1)), rows, above.flatten().to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(names[rows])], names=["node", "cls"])

    # a class has a few nodes in each tree, so its list stays short
    above = stuck.groupBy("cls").agg(F.collect_list("node").alias("above"))
    return classes.join(above, "cls").select("cls", "sig", "above").mapInArrow(branched, "node bigint, cls bigint")


def _sigs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, COORDINATES)


def likely(units: DataFrame, similarity: int, first: bool) -> DataFrame:
    """What in each unit may be linked, by minhashes and sizes of the sets.

    ``units`` has ``unit, cls, comp, n_shingles, sig``. Returns ``unit, a, b``:
    for ``first`` one pair for each class that has a partner of a smaller name;
    else, with ``b`` null, all classes that have a likely partner in another
    component.
    """
    # the minhashes of a link agree in less than ``least`` with a probability below 1e-4, in less than ``sure`` seldom
    p = similarity / 100
    spread = math.sqrt(p * (1 - p) / COORDINATES)
    least, sure = p - 4 * spread, p + 1.5 * spread

    def compare(unit: np.ndarray, cls: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        left, right, unsure = [], [], []
        for step in range(1, len(unit)):
            i = np.flatnonzero(unit[:-step] == unit[step:])
            if i.size == 0:
                break
            # sets of too unequal sizes cannot be alike enough
            alike = 100 * np.minimum(n[i], n[i + step]) >= similarity * np.maximum(n[i], n[i + step])
            i = i[(comp[i] != comp[i + step]) & (cls[i] != cls[i + step]) & alike]
            for part in np.array_split(i, max(1, i.size // 50_000)):
                share = (sig[part] == sig[part + step]).mean(axis=1)
                ok = share >= least
                left.append(part[ok])
                right.append(part[ok] + step)
                unsure.append(share[ok] < sure)
        if not left:
            return _pairs([], [], [])
        i, j, unsure = np.concatenate(left), np.concatenate(right), np.concatenate(unsure)
        if not first:
            rows = np.unique(np.append(i, j))
            return _pairs(unit[rows], cls[rows], [None] * len(rows))
        order = np.lexsort((i, unsure, j))
        i, j = i[order], j[order]
        one = np.append(True, j[1:] != j[:-1])[: j.size]
        return _pairs(unit[j[one]], cls[i[one]], cls[j[one]])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches, 20_000):
            yield compare(*_columns(table))

    ordered = units.select("unit", "cls", "comp", "n_shingles", "sig").repartition("unit").sortWithinPartitions("unit", "cls")
    return ordered.mapInArrow(compared, "unit bigint, a bigint, b bigint")


def _whole_units(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows or more, cut between units; the first column is the unit, in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        last_unit = batch.column(0)[-1]
        if sum(b.num_rows for b in held) < rows or held[0].column(0)[0].equals(last_unit):
            continue
        # everything but the last unit, which may go on in the next batch
        table = pa.Table.from_batches(held)
        last = int(np.searchsorted(table.column(0).to_numpy(), last_unit.as_py()))
        yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: products of incidence matrices, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)  # others are in no intersection
    place = np.full(len(names), -1, dtype=np.int64)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)))
    for at in range(0, len(shared), COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, (at, at + COLUMNS_AT_ONCE))
        there = np.zeros((len(sets), min(COLUMNS_AT_ONCE, len(shared) - at)), dtype=np.float32)
        there[owner[a:b], column[a:b] - at] = 1
        total += there @ there.T
    return total


def settled(units: DataFrame, similarity: int) -> DataFrame:
    """``a, b``: links between components of one unit, as many as join what can be joined.

    ``units`` has ``unit, cls, comp, shingles``.
    """

    def links(cls: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(x) for x in sets])
        common = common_counts(sets)
        i, j = np.nonzero(np.triu(100 * common >= similarity * (sizes[:, None] + sizes - common), 1) & (comp[:, None] != comp))
        _, one = np.unique(np.stack((np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j]))), axis=1, return_index=True)
        parent = {c: c for c in comp.tolist()}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for k in one.tolist():
            x, y = find(int(comp[i[k]])), find(int(comp[j[k]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield int(cls[i[k]]), int(cls[j[k]])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches, 1):
            unit, cls, comp = (table.column(i).to_numpy() for i in range(3))
            borders = [0, *np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)]
            found = []
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column(3).slice(a, b - a).to_pylist()]
                found += links(cls[a:b], comp[a:b], sets)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    ordered = units.select("unit", "cls", "comp", "shingles").repartition("unit").sortWithinPartitions("unit", "cls")
    return ordered.mapInArrow(settle, "a bigint, b bigint").distinct()


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    return (*(table.column(i).to_numpy() for i in range(4)), _sigs(table.column(4)))


def _pairs(unit: list, a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (unit, a, b)], names=["unit", "a", "b"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``cls, shingles`` of the classes whose representative rows ``wanted`` (``key, cls``) names."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, ends = word_hashes(*buffers(batch.column(1)), lower=True)
            sets = [np.unique(shingle_hashes(hashed[a:b], words)).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    # The comparison, always true, marks the side as a selection, for which Spark filters the texts by a Bloom
    # filter of the keys before they are shuffled.
    chosen = wanted.where(F.col("key") >= F.lit(-(1 << 63)))
    rows = id_and_text(docs).withColumn("key", _row_key()).join(chosen, "key").select("cls", "text")
    return rows.mapInArrow(listed, "cls bigint, shingles binary").dropDuplicates(["cls"])


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The ``a, b`` with ``100 * common >= similarity * either`` on the full sets."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = np.intersect1d(x, y, assume_unique=True).size
            out.append(100 * common >= similarity * (x.size + y.size - common))
        return pd.Series(out)

    of_a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
    of_b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(of_a, "a").join(of_b, "b").where(linked("set_a", "set_b")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``cls, comp``: the least class reachable over ``edges`` (``a, b``), for classes that have an edge.

    Labels take the least label among neighbours, then the label of their
    label, until nothing changes; each step is written, so lost executors cost
    no earlier step.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("comp"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, F.col("cls") == F.col("a")).select("cls", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        hooked = materialize(hooked, "hooked")
        above = hooked.select(F.col("cls").alias("parent"), F.col("comp").alias("above"))
        jumped = hooked.join(above, F.col("comp") == F.col("parent")).select("cls", "was", F.least("comp", "above").alias("comp"))
        changed = Observation()
        count = F.count(F.when(F.col("comp") != F.col("was"), 1)).alias("n")
        labels = materialize(jumped.observe(changed, count), "labels").select("cls", "comp")
        if not changed.get["n"]:
            return labels


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after more ``links``: only links between two components are followed."""
    if labels is None:
        return components(links)
    ends = _with_comp(links.select(F.col("a").alias("cls"), "b"), labels).select(F.col("comp").alias("a"), F.col("b").alias("cls"))
    ends = materialize(_with_comp(ends, labels).select("a", F.col("comp").alias("b")).where("a <> b").distinct(), "new-links")
    if ends.isEmpty():
        return labels
    merged = components(ends).select(F.col("cls").alias("old"), F.col("comp").alias("new"))
    known = labels.select("cls", "comp").unionByName(merged.join(labels, F.col("old") == F.col("cls"), "left_anti").select(F.col("old").alias("cls"), F.col("old").alias("comp")))
    moved = known.join(merged, F.col("comp") == F.col("old"), "left").select("cls", F.coalesce("new", "comp").alias("comp"))
    return materialize(moved, "labels")


def _with_comp(units: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return units.withColumn("comp", F.col("cls"))
    known = labels.select(F.col("cls").alias("labelled"), F.col("comp").alias("label"))
    return units.join(known, F.col("cls") == F.col("labelled"), "left").select(*units.columns, F.coalesce("label", "cls").alias("comp"))


class _Search:
    """Components found so far, and the sets that confirm links."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, similarity: int):
        self.docs, self.classes, self.words, self.similarity = docs, classes, words, similarity
        self.sets: DataFrame | None = None
        self.labels: DataFrame | None = None

    def _sets_of(self, members: DataFrame) -> DataFrame:
        missing = members if self.sets is None else members.join(self.sets.select("cls"), "cls", "left_anti")
        wanted = materialize(self.classes.join(missing, "cls", "left_semi").select("key", "cls"), "wanted")
        if not wanted.isEmpty():
            more = materialize(shingle_sets(self.docs, wanted, self.words), "sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def _likely(self, units: DataFrame, first: bool) -> DataFrame:
        signed = _with_comp(units, self.labels).join(self.classes.select("cls", "n_shingles", "sig"), "cls")
        return materialize(likely(signed, self.similarity, first), "likely")

    def partners(self, units: DataFrame) -> bool:
        """Join each class with its likely partner in every unit, where the sets confirm it; whether there was any pair."""
        pairs = self._likely(units, first=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return False
        members = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        confirmed = confirm(pairs, self._sets_of(members), self.similarity)
        self.labels = _joined(self.labels, materialize(confirmed, "links"))
        return True

    def exhaust(self, units: DataFrame) -> None:
        """Join all components that a link within a unit of ``units`` (``unit, cls``) joins."""
        rest = self._likely(units, first=False).select("unit", F.col("a").alias("cls"))
        if rest.isEmpty():
            return
        sets = self._sets_of(rest.select("cls").distinct())
        found = settled(_with_comp(rest, self.labels).join(sets, "cls"), self.similarity)
        self.labels = _joined(self.labels, materialize(found, "more-links"))


def _pieces(stuck: DataFrame, sizes: DataFrame) -> DataFrame:
    """``node, unit, cls`` of large nodes cut into pieces; every piece has the hub."""
    count = F.ceil(F.col("n") / (SMALL_NODE // 2)).cast("int")
    piece = F.pmod(F.xxhash64("cls", "node"), F.col("n_pieces")).cast("int")
    own = stuck.join(sizes, "node").withColumn("n_pieces", count).select("node", piece.alias("piece"), "cls")
    hubs = sizes.withColumn("n_pieces", count).select("node", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"), F.col("hub").alias("cls"))
    return own.unionByName(hubs).select("node", F.xxhash64("node", "piece").alias("unit"), "cls")


def _crowds(stuck: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large nodes with one hub as one: ``node, cls`` and ``node, n, hub``, the hub being the node's name."""
    often = stuck.groupBy("cls").agg(F.count("*").alias("often"))
    rank = F.struct((-F.col("often")).alias("rank"), "cls")
    hubs = stuck.join(often, "cls").groupBy(F.col("node").alias("of")).agg(F.min(rank)["cls"].alias("hub"))
    hubs = materialize(hubs, "hubs")
    members = stuck.join(hubs, F.col("node") == F.col("of")).select(F.col("hub").alias("node"), "cls").distinct()
    members = materialize(members, "crowds")
    sizes = members.groupBy("node").agg(F.count("*").alias("n")).withColumn("hub", F.col("node"))
    return members, materialize(sizes, "crowd-sizes")


def _search_trees(search: _Search, trees: range, depth: int, deeper: int, small_node: int, last: bool) -> None:
    """Join what the nodes of ``trees``, from ``depth`` on ``deeper`` levels down, show to be linked."""

    def unsettled(placed: DataFrame) -> DataFrame:
        """Nodes with classes of two components or more: ``node, n``."""
        sizes = _with_comp(placed, search.labels).groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        return materialize(sizes.where("low <> high").select("node", "n"), "node-sizes")

    units, stuck = None, None
    for level in range(depth, depth + deeper + 1):
        # Only large nodes branch on; what shares a node below a small one is compared in the small one.
        placed = materialize(nodes(search.classes, trees, level) if stuck is None else children(search.classes, stuck), "nodes")
        open_ = materialize(placed.join(unsettled(placed), "node"), "open-nodes")
        small = open_.where(F.col("n") <= small_node).select(F.col("node").alias("unit"), "cls")
        units = small if units is None else units.unionByName(small)
        stuck = open_.where(F.col("n") > small_node)
        if stuck.isEmpty():
            stuck = None
            break
    if stuck is not None:
        stuck, crowds = _crowds(stuck)
        pieces = materialize(_pieces(stuck, crowds), "pieces")
        units = units.unionByName(pieces.select("unit", "cls"))
    units = materialize(units.distinct(), "units")
    if last or search.partners(units):
        search.exhaust(units)
    if stuck is None or not last:
        return
    # Classes outside the hub's component meet every piece of their node.
    comps = _with_comp(stuck, search.labels)
    hub_comp = _with_comp(crowds.select("node", F.col("hub").alias("cls")), search.labels).select(F.col("node").alias("n2"), F.col("comp").alias("hub_comp"))
    outside = comps.join(hub_comp, F.col("node") == F.col("n2")).where("comp <> hub_comp").select("node", "cls")
    outside = materialize(outside, "outside")
    if outside.isEmpty():
        return
    # many outsiders come in parts, so that a unit stays small
    counts = outside.groupBy("node").agg(F.ceil(F.count("*") / (small_node // 2)).cast("int").alias("parts"))
    parts = outside.join(counts, "node").select("node", "cls", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"))
    units_of = pieces.join(counts, "node").select("node", F.col("unit").alias("piece"), "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    piece_names = pieces.select("node", F.col("unit").alias("piece")).distinct()
    theirs = parts.join(piece_names, "node").select("piece", "part", "cls")
    crossed = units_of.select("piece", "part", "cls").unionByName(theirs).select(F.xxhash64("piece", "part").alias("unit"), "cls")
    search.exhaust(materialize(crossed.distinct(), "outside-units"))


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, trees: int = TREES, small_node: int = SMALL_NODE
) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, kept`` per row; ``key`` names the row by a hash of id and text."""
    prepare(docs.sparkSession)
    signed = materialize(signatures(docs, words), "signatures")
    usable = signed.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("cls").agg(F.min(F.struct("doc_id", "key", "n_shingles", "sig")).alias("r"))
    classes = materialize(classes.select("cls", F.col("r.doc_id").alias("low_id"), "r.key", "r.n_shingles", "r.sig"), "classes")
    n = classes.count()
    search = _Search(docs, classes, words, similarity)
    depth = max(1, round(math.log(max(n, 1) / TARGET_NODE, 16))) if n > TARGET_NODE else 1
    first = min(FIRST_TREES, trees - 1)
    if first > 0:
        _search_trees(search, range(first), depth, FIRST_LEVELS, small_node, last=False)
    _search_trees(search, range(first, trees), depth, DEEPER_LEVELS, small_node, last=True)
    labelled = _with_comp(classes.select("cls", "low_id"), search.labels)
    labelled = materialize(labelled, "class-components")
    least = materialize(labelled.groupBy("comp").agg(F.min("low_id").alias("component_id")), "components")
    named = materialize(labelled.join(least, "comp").select(F.col("cls").alias("named"), "component_id"), "named")
    linked = F.when(F.col("doc_id").isNotNull(), F.col("cls"))
    joined = signed.withColumn("linked", linked).join(named, F.col("linked") == F.col("named"), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group."""
    kept = materialize(near_duplicates(docs, **options).where("kept").select(F.col("key").alias("kept_key")), "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64(text))
    whole = docs.select(key.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return whole.join(kept, F.col("__key") == F.col("kept_key"), "left_semi").dropDuplicates(["__key"]).select("__row.*")
