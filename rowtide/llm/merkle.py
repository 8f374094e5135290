"""Merkle manifest of a dataset, its blocks stored in van Emde Boas order.

Each row is a leaf. The leaves of a group, in the order of their ids, are the
bottom of a tree in which ``ARITY`` consecutive nodes have one parent; the
groups' roots are the leaves of one more such tree. A tree is cut into blocks,
aligned subtrees of at most ``BLOCK_HEIGHT`` levels of edges: a block is one row
of the manifest, a flat array of digests. The array is in van Emde Boas order:
the subtree is split at half its height, the top half stored first, then the
bottom halves one after the other, each in the same way. ``addresses`` is the
arithmetic of that order; construction and the retrieval of siblings both go
by it. Block roots are the leaves of the next layer of blocks, until one is left.

A task holds one block, at most ``ARITY ** BLOCK_HEIGHT`` leaves of two digests,
whatever a group's share of the rows; texts are hashed where they are read and
never shuffled.

Defined results: a null field is written ``-``, every other one as its UTF-8
length, ``:`` and its value, so no two rows share an encoding. Groups and ids of
null come first; rows with equal ids are ordered by their digests, so equal rows
are interchangeable. A column that is not there counts as null; other columns
are not read. An empty table has no root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.common import prepare, with_position
from rowtide.session import materialize

BITS = 3
ARITY = 1 << BITS
BLOCK_HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


@cache
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Places of the nodes of a full subtree in van Emde Boas order, one array for each depth from the top."""
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    upper = levels // 2
    top, bottom = addresses(upper), addresses(levels - upper)
    before, each = slots(upper), slots(levels - upper)
    starts = before + each * np.arange(ARITY**upper)
    return (*top, *((starts[:, None] + places).ravel() for places in bottom))


def slots(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def counts(n: int, height: int) -> list[int]:
    """Nodes at each depth of a subtree over ``n`` leaves, the leaves last."""
    return [-(-n // ARITY ** (height - depth)) for depth in range(height + 1)]


def _parent(children: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(children.tobytes().hex().encode()).digest(), dtype=np.uint8)


def build_block(leaves: np.ndarray, height: int) -> np.ndarray:
    """Digests (``slots, 32``) of the subtree over ``leaves`` (``n, 32``); slots without a node are zero."""
    places, sizes = addresses(height + 1), counts(len(leaves), height)
    block = np.zeros((slots(height + 1), DIGEST), dtype=np.uint8)
    block[places[height][: sizes[height]]] = leaves
    for depth in range(height - 1, -1, -1):
        below, n = places[depth + 1], sizes[depth + 1]
        for i in range(sizes[depth]):
            block[places[depth][i]] = _parent(block[below[i * ARITY : min((i + 1) * ARITY, n)]])
    return block


def sibling_runs(block: np.ndarray, n: int, height: int, leaf: int) -> list[tuple[np.ndarray, int]]:
    """Per level upwards the other digests of the run that ``leaf``'s path is in, and its own place in it."""
    runs, sizes = [], counts(n, height)
    for depth in range(height, 0, -1):
        first, own = leaf & ~(ARITY - 1), leaf & (ARITY - 1)
        run = addresses(height + 1)[depth][first : min(first + ARITY, sizes[depth])]
        runs.append((block[np.delete(run, own)], own))
        leaf >>= BITS
    return runs


def pack(runs: list[tuple[np.ndarray, int]]) -> bytes:
    """A level as two bytes, how many siblings and the own place among them, and the siblings."""
    return b"".join(bytes((len(s), own)) + s.tobytes() for s, own in runs)


def siblings(proof: bytes) -> bytes:
    """The siblings alone, level by level."""
    out, at = [], 0
    while at < len(proof):
        size = DIGEST * proof[at]
        out.append(proof[at + 2 : at + 2 + size])
        at += 2 + size
    return b"".join(out)


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that ``leaf`` and a packed proof give."""
    at = 0
    while at < len(proof):
        n, own = proof[at], proof[at + 1]
        run = proof[at + 2 : at + 2 + DIGEST * n]
        leaf = hashlib.sha256((run[: own * DIGEST] + leaf + run[own * DIGEST :]).hex().encode()).digest()
        at += 2 + DIGEST * n
    return leaf


def _height(n: Column) -> Column:
    """Levels of edges over ``n`` leaves: the least number whose power of the arity reaches ``n``, in whole numbers."""
    powers = F.array(*[F.lit(ARITY**k).cast("bigint") for k in range(62 // BITS)])
    return F.size(F.filter(powers, lambda p: p < n))


_BLOCKS = "tree bigint, block bigint, n int, above int, height int, digest binary, nodes binary"


def _built(nodes: DataFrame) -> DataFrame:
    """One layer of blocks of ``nodes`` (``tree, i, above, digest``); ``above`` are the levels of edges left above a node."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, table in _whole_blocks(batches):
            above = table.column("above")[0].as_py()
            height = min(BLOCK_HEIGHT, above)
            leaves = np.frombuffer(b"".join(table.column("digest").to_pylist()), dtype=np.uint8).reshape(-1, DIGEST)
            built = build_block(leaves, height)
            row = [[tree], [block], [len(leaves)], [above - height], [height], [built[0].tobytes()], [built.tobytes()]]
            yield pa.RecordBatch.from_pydict(dict(zip(("tree", "block", "n", "above", "height", "digest", "nodes"), row, strict=True)), schema=_ARROW)

    dealt = nodes.select("tree", F.shiftright("i", BITS * BLOCK_HEIGHT).alias("block"), "i", "above", "digest")
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "i").mapInArrow(blocks, _BLOCKS)


_ARROW = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("above", pa.int32()), ("height", pa.int32()), ("digest", pa.binary()), ("nodes", pa.binary())])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """The rows of one (tree, block) at a time, of batches in that order."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        tree, block = (batch.column(i).to_numpy() for i in (0, 1))
        borders = [0, *np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1, len(tree)]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if name is not None and name != (tree[a], block[a]):
                yield int(name[0]), int(name[1]), pa.Table.from_batches(held)
                held = []
            name = (tree[a], block[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield int(name[0]), int(name[1]), pa.Table.from_batches(held)


def _layers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Blocks of all layers from the bottom, until every tree has its root; ``levels`` is the height of the highest."""
    layers = []
    while True:
        layers.append(materialize(_built(nodes), "manifest"))
        levels -= BLOCK_HEIGHT
        if levels <= 0:
            return layers
        # a tree whose root is in this layer already goes no further
        nodes = layers[-1].where(F.col("above") > 0).select("tree", F.col("block").alias("i"), "above", "digest")


def _roots(layers: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the roots, from whichever layer they are in."""
    found = [layer.where(F.col("above") == 0).select("tree", "digest") for layer in layers]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _node_proofs(layer: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, i, proof`` of each leaf of the blocks of a layer; ``above`` has the proofs of the block roots."""

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, DIGEST)
                first, end = row["block"] << (BITS * BLOCK_HEIGHT), row["proof"] or b""
                out = [pack(sibling_runs(block, row["n"], row["height"], i)) + end for i in range(row["n"])]
                i = first + np.arange(row["n"])
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * row["n"], pa.int64()), pa.array(i, pa.int64()), pa.array(out, pa.binary())], names=["tree", "i", "proof"])

    return _with_proof(layer, above).select("tree", "block", "n", "height", "nodes", "proof").mapInArrow(proofs, "tree bigint, i bigint, proof binary")


def _with_proof(layer: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return layer.withColumn("proof", F.lit(None).cast("binary"))
    found = above.select(F.col("tree").alias("tree_"), F.col("i").alias("i_"), "proof")
    return layer.join(found, (F.col("tree") == F.col("tree_")) & (F.col("block") == F.col("i_")), "left")


def _bottom_proofs(layers: list[DataFrame], roots: DataFrame | None) -> DataFrame:
    """The lowest layer's blocks with the proof of each block's root; ``roots`` has the proofs of whole trees (``tree, proof``)."""
    above = None if roots is None else roots.select("tree", F.lit(0).cast("bigint").alias("i"), "proof")
    for layer in reversed(layers[1:]):
        # trees that end in a lower layer get their proof there
        here = _node_proofs(layer, above)
        above = materialize(here if above is None else here.unionByName(above.join(layer.select("tree").distinct(), "tree", "left_anti")), "proofs")
    return _with_proof(layers[0], above)


def leaf_digest(docs: DataFrame, text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """SHA-256 of a row's fields, as bytes; ``text`` stands for the column of that name."""
    parts = []
    for name in fields:
        value = text if name == "text" and text is not None else F.col(f"`{name}`") if name in docs.columns else F.lit(None)
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def manifest(docs: DataFrame, group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, shown, folded_root`` of each row.

    ``proof`` is packed (see ``pack``); ``shown`` is the leaf that is folded:
    the digest with ``tampered`` as text where that is not null, else ``leaf``.
    """
    spark = prepare(docs.sparkSession)
    leaf = leaf_digest(docs)
    shown = leaf if tampered is None else F.when(tampered.isNotNull(), leaf_digest(docs, tampered)).otherwise(leaf)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{group}`").alias("grp") if group in docs.columns else F.lit(None).cast("string").alias("grp"), leaf.alias("leaf"), shown.alias("shown"))
    placed, _ = with_position(rows, ["grp", "doc_id", "leaf", "shown"], "at", "leaves")
    placed = materialize(placed, "placed")
    # a tree is named by the place of its first leaf
    sizes = placed.groupBy("grp").agg(F.min("at").alias("tree"), F.count("*").alias("leaves"))
    sizes = materialize(sizes.withColumn("above", _height(F.col("leaves"))), "groups")
    total = sizes.agg(F.count("*").alias("n"), F.max("above").alias("levels")).first()
    names = sizes.select(F.col("grp").alias("grp_"), "tree", "above")
    leaves = placed.join(names, F.col("grp").eqNullSafe(F.col("grp_"))).select("doc_id", "leaf", "shown", "tree", (F.col("at") - F.col("tree")).alias("i"), "above")
    leaves = materialize(leaves, "numbered")
    layers = _layers(leaves.select("tree", "i", "above", F.col("leaf").alias("digest")), total["levels"] or 0)
    subroots = materialize(_roots(layers), "subroots")
    ranked, _ = with_position(subroots, ["tree"], "i", "ranked")
    ranked = materialize(ranked, "ranks")
    height = spark.range(1).select(_height(F.lit(total["n"]).cast("bigint")).alias("h")).first()["h"]
    top = _layers(ranked.select(F.lit(0).cast("bigint").alias("tree"), "i", F.lit(height).alias("above"), "digest"), height)
    root = _roots(top).select(F.col("digest").alias("root"))
    root_of_trees = _bottom_proofs(top, None)
    top_proofs = _node_proofs(top[0], root_of_trees.select("tree", F.col("block").alias("i"), "proof")).select(F.col("i").alias("rank"), "proof")
    tree_proofs = materialize(ranked.join(top_proofs, F.col("i") == F.col("rank")).select("tree", "proof", F.col("digest").alias("subroot")), "tree-proofs")
    blocks = _bottom_proofs(layers, tree_proofs.select("tree", "proof")).join(tree_proofs.select(F.col("tree").alias("of"), "subroot"), F.col("tree") == F.col("of"))
    # exactly one row, or none for an empty table
    blocks = blocks.join(F.broadcast(root)).select("tree", "block", "n", "height", "nodes", "proof", "subroot", "root")

    def proven(rows: pa.Table, block: pa.Table) -> pa.Table:
        own = block.to_pylist()[0]
        nodes = np.frombuffer(own["nodes"], dtype=np.uint8).reshape(-1, DIGEST)
        first, out = own["block"] << (BITS * BLOCK_HEIGHT), {"proof": [], "folded_root": []}
        for i, shown in zip(rows.column("i").to_pylist(), rows.column("shown").to_pylist(), strict=True):
            proof = pack(sibling_runs(nodes, own["n"], own["height"], i - first)) + (own["proof"] or b"")
            out["proof"].append(proof)
            out["folded_root"].append(fold(shown, proof))
        n = rows.num_rows
        columns = [rows.column("doc_id"), rows.column("leaf"), pa.array([own["subroot"]] * n, pa.binary()), pa.array([own["root"]] * n, pa.binary()), *(pa.array(x, pa.binary()) for x in out.values()), rows.column("shown")]
        return pa.table(columns, names=["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "shown"])

    dealt = leaves.select("doc_id", "leaf", "shown", "tree", "i", F.shiftright("i", BITS * BLOCK_HEIGHT).alias("of_block"))
    schema = "doc_id bigint, leaf binary, subroot binary, root binary, proof binary, folded_root binary, shown binary"
    return dealt.groupBy("tree", "of_block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(proven, schema)


def proof_digest(proof: Column) -> Column:
    """SHA-256 over the hex digests of a packed proof's siblings, in order."""

    @F.pandas_udf("string")
    def digest(proofs):
        return proofs.map(lambda p: hashlib.sha256(siblings(p).hex().encode()).hexdigest())

    return digest(proof)
