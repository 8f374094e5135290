"""Top-k search, Merkle manifest and conversation trie against plain versions."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.llm import merkle, queries, topk, trie
from rowtide.llm.common import prepare
from tests import oracle
from tests.llm.helpers import SCHEMA, awkward_rows, frame

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
VECTORS = "vec_id bigint, embedding array<double>, row string, tile int, q string, packed string"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
@pytest.mark.parametrize("name", ["op11_pivot_distance", "op12_veb_merkle", "op13_parentheses_trie"])
def test_query_equals_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), queries.ORACLES[name]) is None


# --- top-k ---------------------------------------------------------------------------------------------------------


def _vectors(spark, rows):
    return prepare(spark).createDataFrame([(i, v, "r", 1, "q", "p") for i, v in rows], VECTORS).repartition(3)


def _brute(rows, k, every):
    used = [(i, [math.floor(64.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(used):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for m, (j, v) in enumerate(used) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:k])]
    return sorted(out)


def _searched(spark, rows, k=5, every=4, **sizes):
    found = topk.top_k(_vectors(spark, rows), F.col("vec_id") % every == 0, k=k, **sizes)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def test_search_with_awkward_vectors(spark):
    rng = random.Random(3)
    common = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, common if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200, None), (204, [1.0, None]), (208, [math.nan, 1.0]), (212, [math.inf]), (216, []), (220, [2.0]), (224, [0.5] * 9)]
    rows += [(None, common), (-4, common), (8, rows[8][1]), (8, rows[8][1]), (228, [0.0] * 6)]
    assert _searched(spark, rows, tile=20, pivots=5) == _brute(rows, 5, 4)


def test_search_with_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1e7) for _ in range(5)]) for i in range(40)]
    assert _searched(spark, rows, tile=10, pivots=3) == _brute(rows, 5, 4)
    rows.append((44, [1e12] * 5))
    clipped = [(q, r, v, max(min(s, 2**63 - 1), -(2**63))) for q, r, v, s in _brute(rows, 5, 4)]
    assert [(q, r, s) for q, r, _, s in _searched(spark, rows, tile=10, pivots=3)] == [(q, r, s) for q, r, _, s in clipped]


def test_search_of_few_rows(spark):
    assert _searched(spark, []) == []
    assert _searched(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert _searched(spark, [(4, [1.0])]) == []
    assert _searched(spark, [(4, [1.0]), (5, [2.0])]) == [(4, 1, 5, 64 * 128)]


def test_bounds_leave_tiles_out(spark):
    """Queries among far clusters visit few tiles, and none that could hold a better one is left out."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 40] * 10 + rng.normal(size=8) * 0.05).tolist()) for i in range(2000)]
    index, space = topk.build_index(_vectors(spark, rows), "vec_id", "embedding", 64.0, pivots=40, tile=50)
    table = index.toArrow()
    q, vec_id, tile = space.matrix(table.column("packed")), table.column("vec_id").to_numpy(), table.column("tile").to_numpy()
    chosen = np.flatnonzero(vec_id % 20 == 0)
    scores = space.scores(q[chosen], q).astype(np.int64)
    floor = np.sort(scores, axis=1)[:, -6]
    i, tiles = space.visits(q[chosen], floor, 0, 10**6)
    visited = set(zip(i.tolist(), tiles.tolist(), strict=True))
    for n in range(len(chosen)):
        assert {int(t) for t in tile[scores[n] >= floor[n]]} <= {t for m, t in visited if m == n}
    assert len(visited) < 0.5 * len(chosen) * len(np.unique(tile))
    assert _searched(spark, rows, every=20, pivots=40, tile=50) == _brute(rows, 5, 20)


# --- Merkle manifest -----------------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _tree(level):
    levels = [level]
    while len(level) > 1:
        level = [_h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        levels.append(level)
    return levels


def _siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        out.append((level[first:i], level[i + 1 : first + 8]))
        i //= 8
    return out


def _plain_manifest(rows):
    """rows of (doc_id, text, lang, source, n_chars)"""
    def low(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def leaf(row, text):
        return _h(*(_field(v) for v in (row[0], row[3], row[2], row[4], text)))

    groups = {}
    for row in rows:
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        groups.setdefault(row[2], []).append((row[0], leaf(row, row[1]), leaf(row, low(row[1]) if changed else row[1])))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees.append(_tree([x[1] for x in groups[name]]))
    top = _tree([t[-1][0] for t in trees])
    out = []
    for g, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for i, (doc_id, own, shown) in enumerate(groups[name]):
            path = _siblings(tree, i) + _siblings(top, g)
            proof = _h(*(d for left, right in path for d in (*left, *right)))
            for left, right in path:
                shown = _h(*left, shown, *right)
            out.append((doc_id, own, tree[-1][0], top[-1][0], proof, shown, shown == top[-1][0]))
    return sorted(out, key=repr)


def _manifest(docs):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    proven = merkle.manifest(docs, tampered=F.when(chosen, F.translate("text", letters, letters.lower())))
    hexed = [F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")]
    rows = proven.select("doc_id", *hexed, merkle.proof_digest(F.col("proof")), F.lower(F.hex("folded_root")), F.col("folded_root") == F.col("root")).collect()
    return sorted(map(tuple, rows), key=repr)


def test_manifest_of_awkward_rows(spark):
    rows = awkward_rows()
    assert _manifest(frame(spark, rows)) == _plain_manifest([r[:5] for r in rows])
    assert _manifest(spark.createDataFrame([], SCHEMA)) == []
    one = [(7, "A b", None, "s", None, *[None] * 6)]
    assert _manifest(frame(spark, one)) == _plain_manifest([one[0][:5]])


def test_manifest_of_many_layers(spark, monkeypatch):
    """Small blocks give several layers, below and above the groups' roots."""
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", 1)
    rows = [(i, f"Text {i}", f"l{i % 5 if i % 3 else 0}", "s", i, *[None] * 6) for i in range(700)]
    rows += [(1000 + i, "T", f"m{i}", None, 1, *[None] * 6) for i in range(70)]
    assert _manifest(frame(spark, rows)) == _plain_manifest([r[:5] for r in rows])


@pytest.mark.parametrize("levels", range(1, 6))
def test_addresses_are_halved_subtrees(levels):
    places = merkle.addresses(levels)
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.slots(levels)))
    if levels > 1:
        upper = levels // 2
        top = np.concatenate(places[:upper])
        assert top.max() == merkle.slots(upper) - 1
        for n, first in enumerate(places[upper]):
            below = [d[n * 8**k : (n + 1) * 8**k] for k, d in enumerate(places[upper:])]
            assert first == merkle.slots(upper) + n * merkle.slots(levels - upper)
            assert sorted(np.concatenate(below).tolist()) == list(range(first, first + merkle.slots(levels - upper)))


# --- conversation trie ---------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, a string, depth int, of string"


def _digest(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def _plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, _digest(role, text), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}

    def below(p):
        return [p] + [x for q in kids[p] for x in below(q)]

    out = []
    for p, convs in members.items():
        under = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(p))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _trie(spark, rows, **options):
    frame = prepare(spark).createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS).repartition(3)
    c = F.col("conv_id")
    found = trie.trie(frame, F.crc32(c.cast("string").cast("binary")) % 6, c - c % 100, **options)
    return sorted(map(tuple, found.collect()), key=repr)


def _talks(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(0, 60), *range(100, 140), 205, 206, 333, -5, -101, -100]:
        for turn in range(rng.choice([1, 2, 3, 4, 7])):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["a", "bb", "Ünï", "日本", "x\n"])))
    return rows


def test_trie_of_awkward_rows(spark):
    rows = _talks(1)
    rows += [(7, None, None, None), (7, None, "user", ""), (8, 0, None, "late"), (None, 0, "user", "lost"), (9, 1, "user", None), rows[5], rows[5]]
    assert _trie(spark, rows) == _plain_trie(rows)
    assert _trie(spark, []) == []
    assert _trie(spark, [(3, None, None, None)]) == _plain_trie([(3, None, None, None)])


def test_trie_over_small_shards_and_ranges(spark, monkeypatch):
    """Spines shared by many shards, copies, a chain of conversations each one turn longer, ranges of four turns."""
    monkeypatch.setattr(trie, "RANGE_BITS", 2)
    monkeypatch.setattr(trie.running_sums, "__defaults__", (2,))
    monkeypatch.setattr(trie, "PIECE", 6)
    rows = _talks(2)
    for n in range(40):
        rows += [(1000 + n, turn, "user", f"t{turn}") for turn in range(n)]
    rows += [(conv, turn, "user", "same") for conv in range(2000, 2030) for turn in range(3)]
    rows += [(5000, turn, "user", str(turn % 3)) for turn in range(60)]
    assert _trie(spark, rows, shard=10) == _plain_trie(rows)


def test_find_close_is_what_a_stack_finds():
    rng = random.Random(6)
    for size in (1, 2, 5, 300, 3000):
        bits, depth = [], 0
        while len(bits) < 2 * size:
            left = 2 * size - len(bits)
            up = depth == 0 or (depth < left and rng.random() < rng.choice([0.2, 0.9]))
            bits.append(int(up))
            depth += 1 if up else -1
        stack, want = [], {}
        for i, bit in enumerate(bits):
            if bit:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opened, closed = trie.find_close(np.array(bits, dtype=bool))
        assert dict(zip(opened.tolist(), closed.tolist(), strict=True)) == want
