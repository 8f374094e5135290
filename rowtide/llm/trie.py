"""Prefix trie of conversations, encoded as balanced parentheses per shard.

A node is a distinct sequence of first turns. Its name is a hash of sums of
hashes of (depth, turn), so names come from running sums along a conversation;
these are taken over ranges of turns, and a conversation of any length never is
in one task. Members, ends and children of a node are aggregates by name.

Nodes with one child where no conversation ends form chains, and a chain is
known by its last node, the key node. What is encoded are paths of key nodes,
one path for each distinct conversation. A shard holds a run of them in sorted
order, which is a depth-first order of the trie: one opening and one closing
parenthesis a node. The closing one is found by the minima of the excess over
blocks and a tree above them, the leaves of a subtree are counted by the rank
of leaf pairs between the two, and its savings by cumulative sums. Nodes on the
border of shards, the shared spines, are in several; each path carries a node's
weight and leaf only once, so the sums of all shards merge by adding.

A path has at most about the square root of twice the number of turns as key
nodes, since each of them ends a conversation or parts two; it is all that is
held of one conversation. Identical conversations share a path.

Defined results: rows without an id take no part. Null roles and texts are
empty, null turns come first, and turns of one number are ordered by the hash of
role and text. A conversation that is only named as another one's beginning
has no path. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.llm.common import prepare, with_position
from rowtide.session import materialize

MOST_SHARED = 5  # turns taken over from another conversation
RANGE_BITS = 16  # turns a window sorts at most
SHARD = 1 << 18  # parentheses of a shard
BLOCK = 256  # parentheses of a block
PIECE = 1 << 16  # bytes of ids joined before they are shuffled


def running_sums(df: DataFrame, group: str, order: str, columns: Sequence[str], bits: int = RANGE_BITS) -> DataFrame:
    """Replace ``columns`` by their running sums in each group; ``order`` numbers a group's rows without many gaps.

    Windows run inside ranges of ``2**bits`` numbers, and the sums before a
    range are one row for each range after a group's first.
    """
    ranged = df.withColumn("__range", F.shiftright(order, bits))
    upto = Window.partitionBy(group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(*[c for c in ranged.columns if c not in columns], *[F.sum(c).over(upto).alias(c) for c in columns])
    before = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__at")).agg(*[F.sum(c).alias(c) for c in columns])
    carried = totals.select("__group", "__at", *[F.sum(c).over(before).alias(f"__{c}") for c in columns]).where("__at > 0")
    joined = local.join(carried, (F.col(group) == F.col("__group")) & (F.col("__range") == F.col("__at")), "left")
    return joined.select(*[(F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) if c in columns else F.col(c) for c in df.columns])


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, i, digest, length`` of every turn in its order, and ``n``, the turns of its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("bigint").alias("length"))
    placed, _ = with_position(turns, ["conv_id", "turn", "digest"], "at", "turns")
    placed = materialize(placed.drop("turn"), "placed")
    starts = placed.groupBy(F.col("conv_id").alias("of")).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    joined = placed.join(starts, F.col("conv_id") == F.col("of"))
    return joined.select("conv_id", (F.col("at") - F.col("start")).alias("i"), "digest", "length", "n")


def rebuilt(turns: DataFrame, shared: Column, base: Column) -> DataFrame:
    """``conv_id, depth, digest, length, last``: the first ``shared`` turns of conversation ``base``, then the own ones after as many.

    Both are columns over ``conv_id``; ``shared`` is at most ``MOST_SHARED``. A
    row of depth 0 stands for the root; ``last`` is the depth at which the
    conversation ends.
    """
    convs = turns.where("i = 0").select("conv_id", "n")
    of_base = convs.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"))
    plan = convs.select("conv_id", "n", shared.cast("bigint").alias("h"), base.alias("base")).join(of_base, F.col("base") == F.col("base_id"), "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = plan.select(F.col("conv_id").alias("conv"), "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last"))
    plan = materialize(plan, "plans")
    own = turns.join(plan, F.col("conv_id") == F.col("conv")).where("i >= h").select(
        "conv", (F.col("k") + F.col("i") - F.col("h") + 1).alias("depth"), "digest", "length", "last")
    first = turns.where(F.col("i") < MOST_SHARED).join(plan, F.col("conv_id") == F.col("base")).where("i < h").select(
        "conv", (F.col("i") + 1).alias("depth"), "digest", "length", "last")
    root = plan.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("bigint").alias("length"), "last")
    return own.unionByName(first).unionByName(root).withColumnRenamed("conv", "conv_id")


_LANES = ("s0", "s1", "s2", "s3")


def _name(depth: Column, sums: Sequence[Column], label: str) -> list[Column]:
    """128 bits of name from a depth and its sums."""
    return [F.xxhash64(depth, *sums).alias(f"{label}a"), F.xxhash64(F.lit(1), *reversed(sums), depth).alias(f"{label}b")]


def named(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, last, length, a, b, pa, pb``: the node each row reaches and its parent (null for the root)."""
    x, y = F.xxhash64("digest", "depth"), F.xxhash64(F.lit(7), "depth", "digest")
    # 32-bit parts: their sums stay exact over 2**31 turns
    parts = [v for h in (x, y) for v in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    laned = turns.select("conv_id", "depth", "last", "length", *[p.alias(c) for c, p in zip(_LANES, parts, strict=True)], F.array(*parts).alias("own"))
    summed = running_sums(laned, "conv_id", "depth", _LANES)
    here = [F.col(c) for c in _LANES]
    before = [F.when(F.col("depth") > 0, F.col(c) - F.col("own")[i]) for i, c in enumerate(_LANES)]
    parent = [F.when(F.col("depth") > 0, c).alias(f"p{x}") for c, x in zip(_name(F.col("depth") - 1, before, "p"), "ab", strict=True)]
    return summed.select("conv_id", "depth", "last", "length", *_name(F.col("depth"), here, ""), *parent)


def find_close(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the opening parentheses of a balanced sequence (1 opens) and of the ones that close them."""
    excess = np.cumsum(np.where(opens, 1, -1))
    padded = np.full(-(-len(excess) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
    padded[: len(excess)] = excess
    blocks = padded.reshape(-1, BLOCK)
    width = 1 << (len(blocks) - 1).bit_length()
    least = np.full(2 * width, np.iinfo(np.int64).max)
    least[width : width + len(blocks)] = blocks.min(axis=1)
    for i in range(width - 1, 0, -1):
        least[i] = min(least[2 * i], least[2 * i + 1])
    at = np.flatnonzero(opens)
    goal, closes = excess[at] - 1, np.full(len(at), -1)

    def scan(which: np.ndarray, block: np.ndarray, after: np.ndarray) -> None:
        for part in range(0, len(which), 4096):
            w, b, low = which[part : part + 4096], block[part : part + 4096], after[part : part + 4096]
            hit = (blocks[b] <= goal[w][:, None]) & (np.arange(BLOCK) > low[:, None])
            there = hit.any(axis=1)
            closes[w[there]] = b[there] * BLOCK + hit[there].argmax(axis=1)

    scan(np.arange(len(at)), at // BLOCK, at % BLOCK)
    far = np.flatnonzero(closes < 0)
    node, aim = at[far] // BLOCK + width, goal[far]
    climbing = np.ones(len(far), dtype=bool)
    while climbing.any():  # to the nearest right neighbour of the path whose least excess is low enough
        right = climbing & (node % 2 == 0) & (least[np.minimum(node + 1, 2 * width - 1)] <= aim)
        node = np.where(right, node + 1, np.where(climbing, node // 2, node))
        climbing &= ~right
    while (inner := node < width).any():  # down to the first such block
        left = least[np.where(inner, 2 * node, node)] <= aim
        node = np.where(inner, np.where(left, 2 * node, 2 * node + 1), node)
    scan(far, node - width, np.full(len(far), -1))
    return at, closes


class _Shard:
    """Parentheses of a run of sorted paths."""

    def __init__(self) -> None:
        self.bits, self.names, self.weights, self.leaf, self.path, self.places = [], [], [], [], [], []

    def add(self, path: list[tuple]) -> None:
        same = 0
        while same < min(len(path), len(self.path)) and path[same][:2] == self.path[same]:
            same += 1
        self.bits += [0] * (len(self.path) - same)
        del self.path[same:], self.places[same:]
        for a, b, _, leaf in path[same:]:
            self.places.append(len(self.names))
            self.path.append((a, b))
            self.names.append((a, b))
            self.weights.append(0)
            self.leaf.append(leaf)
            self.bits.append(1)
        for place, step in zip(self.places, path, strict=True):
            self.weights[place] += step[2]

    def sums(self) -> pa.RecordBatch:
        bits = np.array(self.bits + [0] * len(self.path), dtype=bool)
        opened, closed = find_close(bits)
        weight, pair = np.zeros(len(bits), dtype=np.int64), np.zeros(len(bits), dtype=np.int64)
        weight[opened] = self.weights
        # a node whose children are all in later shards looks like a leaf here and is none
        pair[opened] = ~bits[opened + 1] & np.array(self.leaf, dtype=bool)
        weight, pair = (np.append(0, np.cumsum(x)) for x in (weight, pair))
        a, b = (pa.array([n[k] for n in self.names], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b, *(pa.array(x[closed] - x[opened], pa.int64()) for x in (pair, weight))], names=["ka", "kb", "n_leaves", "weight"])


def subtree_sums(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """``ka, kb, n_leaves, weight`` of every key node over its subtree; ``paths`` has ``path`` of ``a, b, weight, leaf``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Shard()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held.add([(p["a"], p["b"], p["weight"], p["leaf"]) for p in path])
                if len(held.bits) >= shard:
                    yield held.sums()
                    held = _Shard()
        if held.bits:
            yield held.sums()

    key = F.transform("path", lambda p: F.struct(p["a"], p["b"]))
    ordered = paths.select("path", key.alias("key")).repartitionByRange("key").sortWithinPartitions("key").select("path")
    parts = ordered.mapInArrow(encoded, "ka bigint, kb bigint, n_leaves bigint, weight bigint")
    return parts.groupBy("ka", "kb").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("weight").alias("weight"))


def end_digests(ends: DataFrame) -> DataFrame:
    """``ea, eb, ends_sha256``: of each node where conversations end, over their ids in ascending order.

    Ids are joined to pieces where they lie; one task then reads a node's
    pieces in turn and holds one of them at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, held, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (name != (a, b) or size >= PIECE):
                    out.append((*name, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    name, first = (a, b), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield _rows(out, ("ea", "eb", "first", "piece"))
                out = []
        if held:
            yield _rows([(*name, first, ",".join(held))], ("ea", "eb", "first", "piece"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, out = None, None, []
        for batch in batches:
            for a, b, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if name == (a, b):
                    state.update(b"," + piece.encode())
                    continue
                if name is not None:
                    out.append((*name, state.hexdigest()))
                name, state = (a, b), hashlib.sha256(piece.encode())
            if out:
                yield _rows(out, ("ea", "eb", "ends_sha256"))
                out = []
        if name is not None:
            yield _rows([(*name, state.hexdigest())], ("ea", "eb", "ends_sha256"))

    keys = ["a", "b", "conv_id"]
    joined = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pieces, "ea bigint, eb bigint, first bigint, piece string")
    ordered = joined.repartition("ea", "eb").sortWithinPartitions("ea", "eb", "first")
    return ordered.mapInArrow(digests, "ea bigint, eb bigint, ends_sha256 string")


def _rows(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=list(names))


def trie(conversations: DataFrame, shared: Column, base: Column, shard: int = SHARD) -> DataFrame:
    """Every node of the trie of the conversations rebuilt by ``shared`` and ``base`` (see ``rebuilt``).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``, the saved tokens counted in code points.
    """
    prepare(conversations.sparkSession)
    turns = materialize(turn_rows(conversations), "turn-rows")
    reached = materialize(named(rebuilt(turns, shared, base)), "reached")
    ends = F.col("depth") == F.col("last")
    nodes = reached.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("length").alias("length"), F.min("pa").alias("pa"),
        F.min("pb").alias("pb"), F.count("*").alias("n_convs"), F.count(F.when(ends, 1)).alias("n_ends"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("ca"), F.col("pb").alias("cb")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left")
    nodes = nodes.join(parents, (F.col("pa") == F.col("qa")) & (F.col("pb") == F.col("qb")), "left")
    n_children = F.coalesce("n_children", F.lit(0))
    is_key = (F.col("n_ends") > 0) | (n_children != 1) | (F.col("depth") == 0)
    nodes = nodes.select(
        "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), is_key.cast("bigint").alias("is_key"),
        ((F.col("n_convs") - 1) * F.col("length")).alias("own"))
    nodes = nodes.withColumns({"keys": F.col("is_key"), "upto": F.col("own")})
    # The nodes whose smallest member is one conversation are the lower end of its path.
    nodes = running_sums(materialize(nodes, "tree"), "conv_id", "depth", ["keys", "upto"])
    nodes = materialize(nodes.withColumn("chain", F.col("keys") - F.col("is_key")), "chained")
    key = F.when(F.col("is_key") == 1, F.struct("a", "b", "n_children"))
    chains = nodes.groupBy(F.col("conv_id").alias("of"), F.col("chain").alias("chain_")).agg(
        F.max(key).alias("k"), F.sum("own").alias("weight"), F.max("upto").alias("end"))
    chains = materialize(chains.select("of", "chain_", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "weight", "end", (F.col("k.n_children") == 0).alias("leaf")), "chains")
    enders = reached.where(ends).groupBy("a", "b").agg(F.min("conv_id").alias("ender")).select("ender")
    walked = reached.join(enders, F.col("conv_id") == F.col("ender"), "left_semi").select("conv_id", "depth", "a", "b")
    keyed = walked.join(chains, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")))
    # a node's smallest member is the smallest that ends where it ends, so exactly one path carries the weight
    step = F.struct("depth", "a", "b", F.when(F.col("of") == F.col("conv_id"), F.col("weight")).otherwise(F.lit(0)).alias("weight"), "leaf")
    paths = keyed.groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("path")).select("path")
    sums = materialize(subtree_sums(paths, shard).withColumnRenamed("weight", "below"), "sums")
    whole = chains.join(sums.select(F.col("ka").alias("sa"), F.col("kb").alias("sb"), "n_leaves", "below"), (F.col("ka") == F.col("sa")) & (F.col("kb") == F.col("sb")))
    found = nodes.join(whole, (F.col("conv_id") == F.col("of")) & (F.col("chain") == F.col("chain_")))
    found = found.join(end_digests(reached.where(ends)), (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), "left")
    saved = F.col("below") - F.col("weight") + F.col("end") - F.col("upto") + F.col("own")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
