"""Exact dedup, near-dedup and line dedup against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rowtide.llm import exact_dedup, line_dedup, minhash
from tests.llm.helpers import SCHEMA, awkward_rows, components, frame, shingles, text_of


def test_exact_dedup(spark):
    rows = awkward_rows()
    got = exact_dedup.new_index(spark, 4).ingest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    keep = {hashlib.sha256(t.encode()).digest(): max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    size = {hashlib.sha256(t.encode()).digest(): len(ids) for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        digest = bytes(r["digest"])
        assert (r["keep_id"], r["group_size"]) == (keep[digest], size[digest])
        kept[digest] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_index_persists(spark):
    index = exact_dedup.new_index(spark, 4)
    first = frame(spark, [(1, "a", *[None] * 9), (2, "b", *[None] * 9)])
    assert exact_dedup.drop_duplicates(first, index).count() == 2
    again = exact_dedup.DigestIndex(spark, index.location, 4)
    later = frame(spark, [(9, "a", *[None] * 9), (8, "c", *[None] * 9), (7, "c", *[None] * 9)])
    stays = exact_dedup.drop_duplicates(later, again)
    assert stays.columns == later.columns and [r["doc_id"] for r in stays.collect()] == [8]
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.ingest(later).collect()} == {9: (1, False), 8: (8, True), 7: (8, False)}
    assert again.table().count() == 3


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rows = awkward_rows()
    got = minhash.near_duplicates(frame(spark, rows), words=words).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    want = components(texts, words)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(shingles(texts[r["doc_id"]], words)), want[r["doc_id"]])
            assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])


def test_crowd_of_near_copies(spark):
    """Nodes far over the limit: a crowd around one text, another one next to it, and links out of the crowd."""
    rng = random.Random(3)
    base = text_of(rng, 40).split()
    texts = {}
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(40), 1 + (i % 3)):
            words[k] = f"new{i}x{k}"
        texts[i] = " ".join(words)
    for i in range(300, 340):
        texts[i] = text_of(rng, 30)
    frame_ = frame(spark, [(i, t, *[None] * 9) for i, t in texts.items()])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame_, words=2, small_node=32).collect()}
    assert got == components(texts, 2)


class _Recorder:
    """What a search is given, as ``unit -> classes``; it finds no links."""

    def __init__(self, classes):
        self.classes, self.labels, self.units = classes, None, {}

    def partners(self, units):
        for r in units.collect():
            self.units.setdefault(r["unit"], set()).add(r["cls"])
        return False

    exhaust = partners


def test_only_large_nodes_branch_on(spark):
    """What is below a small node was compared in it; it must not come again, in its own tree or by way of another."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, minhash.COORDINATES)
    sigs = np.where(rng.random((400, minhash.COORDINATES)) < 0.7, base, rng.integers(0, 3, (400, minhash.COORDINATES))).astype("<u2")
    classes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "cls bigint, sig binary")
    search, trees, small = _Recorder(classes), range(6), 150
    minhash._search_trees(search, trees, 1, 2, small, last=False)
    wanted, below = {}, 0
    for tree in trees:
        large = set(range(400))
        for depth in (1, 2, 3):
            members = {}
            for row, path in zip(*minhash.walk(sigs, range(tree, tree + 1), depth), strict=True):
                members.setdefault(int(path.view(np.int64)), set()).add(int(row))
            found = {node for node in members if node in search.units}
            assert all(search.units[node] == members[node] for node in found)
            assert {c for node in found for c in members[node]} <= large
            below += len(found) if depth > 1 else 0
            wanted |= {node: m for node, m in members.items() if 1 < len(m) <= small and m <= large} if depth == 1 else {}
            large = {c for m in members.values() if len(m) > small for c in m}
    assert wanted.keys() <= search.units.keys() and below > 0


def test_hub_is_what_most_large_nodes_share(spark):
    """Large nodes of a crowd are one by what nearly all of them hold, though each has another least class."""
    rows = [(node, cls) for node in range(5) for cls in [node, 100, *range(200 + node, 230 + node)]]
    members, sizes = minhash._crowds(spark.createDataFrame(rows, "node bigint, cls bigint"))
    assert [(r["node"], r["hub"]) for r in sizes.collect()] == [(100, 100)]
    assert sorted(r["cls"] for r in members.collect()) == sorted({cls for _, cls in rows})


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (0, 1, 40, 900, 900, 2500)]
    got = minhash.common_counts([*sets, sets[3]])
    for i, x in enumerate([*sets, sets[3]]):
        for j, y in enumerate([*sets, sets[3]]):
            shared = np.intersect1d(x, y).size
            assert got[i, j] == shared or i == j  # what only one set has is not counted with itself


def test_paths_meet_as_often_as_planned():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 1 << 16, (2000, minhash.COORDINATES))
    other = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 1 << 16, one.shape))
    for depth in (1, 3, 5):
        met = set(zip(*(x.tolist() for x in minhash.walk(one.astype("<u2"), range(minhash.TREES), depth)), strict=True))
        met &= set(zip(*(x.tolist() for x in minhash.walk(other.astype("<u2"), range(minhash.TREES), depth)), strict=True))
        assert len({row for row, _ in met}) >= 1999


def test_drop_near_duplicates(spark):
    docs = frame(spark, awkward_rows())
    stays = minhash.drop_near_duplicates(docs)
    assert stays.dtypes == docs.dtypes
    want = components({r[0]: r[1] for r in awkward_rows() if r[0] is not None}, 5)
    ids = [r["doc_id"] for r in stays.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 3


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    assert exact_dedup.new_index(spark, 2).ingest(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def plain_chunks(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, start = [], 0
    for i, h in enumerate(hashes):
        if (h + 3 * (hashes[i - 1] if i else 0)) % 4 == 0 or i == len(lines) - 1:
            out.append((start, i + 1))
            start = i + 1
    return lines, out


def test_line_chunks(spark):
    rng = random.Random(5)
    passage = "\n".join(text_of(rng, 8) for _ in range(12))
    rows = awkward_rows()
    start = max(r[0] for r in rows if r[0] is not None) + 1
    for i in range(12):
        own = "\n".join(text_of(rng, 5) for _ in range(rng.randrange(4)))
        rows.append((start + i, f"{own}\n{passage}\n{text_of(rng, 3)}", *[None] * 9))
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    first = {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for r in order:
        if r[1] is None:
            want[r[0], None] = (None, 0)
            continue
        if (r[0], r[1]) in want:
            continue
        lines, ranges = plain_chunks(r[1])
        kept, gone = [], 0
        for a, b in ranges:
            body = "\n".join(lines[a:b])
            repeated = b - a >= 2 and any(c.isalnum() for c in body) and body in first
            first.setdefault(body, True) if b - a >= 2 else None
            gone += repeated
            kept += [] if repeated else lines[a:b]
        want[r[0], r[1]] = ("\n".join(kept), gone)
    source = {}
    for r in rows:
        source.setdefault(r[0], []).append(r[1])
    for r in got:
        answers = {want[r["doc_id"], t] for t in source[r["doc_id"]]}
        assert (r["text"], len(r["removed"])) in answers
    assert sum(len(r["removed"]) for r in got) > 10


def test_line_passages(spark):
    """Passages of two to five lines between other lines: all found, and nothing is lost that is not kept earlier."""
    rng = random.Random(8)
    rows, planted = awkward_rows(), []
    start = max(r[0] for r in rows if r[0] is not None) + 1
    for k in range(40):
        passage = [text_of(rng, 60 // (2 + k % 4) + 1) for _ in range(2 + k % 4)]
        for _ in range(2):
            own = [[text_of(rng, 5) for _ in range(rng.randrange(1, 4))] for _ in range(2)]
            planted.append((start, "\n".join(passage), len(own[0]), len(passage)))
            rows.append((start, "\n".join([*own[0], *passage, *own[1]]), *[None] * 9))
            start += 1
    crowd = text_of(rng, 30)
    rows += [(start, f"{crowd}\n" * 5, *[None] * 9), (start + 1, f"x\n{crowd}\n{crowd}\ny\n", *[None] * 9)]
    got = line_dedup.dedup_lines(frame(spark, rows), pairs=True).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, (doc_id, passage, first, n) in enumerate(planted):
        assert [tuple(x) for x in by_id[doc_id]["removed"]] == ([(first, first + n)] if i % 2 else [])
        assert (passage in by_id[doc_id]["text"]) == (i % 2 == 0)
    assert by_id[start]["text"] == f"{crowd}\n{crowd}\n" and [tuple(x) for x in by_id[start + 1]["removed"]] == [(1, 3)]
    texts = {(r[0], r[1]) for r in rows}
    kept = {line for r in got for line in (r["text"] or "").split("\n")}
    for doc_id, text in texts:
        assert kept >= set((text or "").split("\n"))
        wanted = [r for r in got if r["doc_id"] == doc_id and r["n_lines"] == (0 if text is None else text.count("\n") + 1)]
        lines = (text or "").split("\n")
        for r in wanted if doc_id is not None else []:
            gone = {i for a, b in r["removed"] for i in range(a, b)}
            assert r["text"] == (None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
