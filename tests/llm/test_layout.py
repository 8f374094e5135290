"""Mixing, sharding, the registered queries and the pipeline."""

import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowtide.llm import exact_dedup, minhash, mixing, queries, sharding, toxicity
from rowtide.llm.common import read_table
from tests import oracle
from tests.llm.helpers import SCHEMA, awkward_rows, components, frame

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


def test_mix_reaches_weights(spark):
    rows = [(i, "x" * 100, None, f"s{i % 7 // 3}", 100, *[None] * 6) for i in range(7000)]
    weights = {"s0": 0.2, "s1": 0.3, "s2": 0.5}
    mixed = mixing.mix(frame(spark, rows), weights=weights, epochs=2.0)
    counts = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for name, share in weights.items():
        assert abs(counts[name] / 14_000 - share) < 0.02
    positions = sorted(r["position"] for r in mixed.collect())
    assert positions == list(range(len(positions)))
    again = mixing.mix(frame(spark, rows).repartition(5), weights=weights, epochs=2.0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_mix_awkward_rows(spark):
    docs = frame(spark, awkward_rows())
    counted = mixing.replication_counts(docs)
    assert counted.count() == docs.count()
    whole = mixing.mixed_rows(docs)
    assert whole.dtypes == docs.dtypes
    assert whole.count() == counted.agg(F.sum("copies")).first()[0] == mixing.mix(docs).count()
    assert mixing.mix(docs, weights={"nobody": 1.0}).count() == 0
    assert mixing.mix(docs, weights={None: 1.0}).select("source").distinct().collect() == [(None,)]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    # a rate far beyond what exp(-rate) can hold
    rate = spark.range(1).select(mixing._distribution(F.lit(2000.0)).alias("cdf")).first()["cdf"]
    assert abs(rate[2000] - 0.5) < 0.01 and abs(rate[-1] - 1) < 1e-9


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 3), (4, 2), (1, 4), (2, 1)])
def test_hilbert_steps(spark, n, bits):
    """Neighbours on the curve are neighbours in space, and every place is visited."""
    cells = spark.range(2 ** (n * bits)).select(*[F.shiftright("id", i * bits).bitwiseAND(2**bits - 1).cast("int").alias(f"c{i}") for i in range(n)])
    rows = sorted(tuple(r) for r in cells.select(sharding.hilbert_index([F.col(c) for c in cells.columns], bits), *cells.columns).collect())
    assert [r[0] for r in rows] == list(range(2 ** (n * bits)))
    assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark, tmp_path):
    rows = awkward_rows()
    docs = frame(spark, rows)
    got = sharding.shard(docs, 8).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    curve = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert curve == sorted(curve)
    few = sharding.shard(frame(spark, rows[:3]), 8).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 8).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("__shard").distinct().count() == 4


def test_shards_prune(spark):
    """A shard sees far fewer values of each column than there are."""
    rows = [(i, "t", f"l{i % 4}", f"src{i * 7 % 64:02d}", i * 13 % 5000, *[None] * 6) for i in range(8192)]
    got = sharding.shard(frame(spark, rows), 64).select("doc_id", "shard").collect()
    seen = {}
    for r in got:
        seen.setdefault(r["shard"], set()).add(r["doc_id"] * 7 % 64)
    assert sum(len(v) for v in seen.values()) / 64 < 32


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    difference = oracle.compare(queries.QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), queries.ORACLES[name])
    assert difference is None


@needs_tables
def test_near_duplicates_of_the_table(spark):
    docs = read_table(spark, SF_DIR, "documents")
    want = components({r["doc_id"]: r["text"] for r in docs.collect()}, 2)
    got = {r["doc_id"]: r["component_id"] for r in queries.op1_chosen_path(spark, SF_DIR).collect()}
    assert got == want


@needs_tables
def test_pipeline(spark):
    """Every stage against a plain version on its own input."""
    docs = read_table(spark, SF_DIR, "documents")
    columns = docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = toxicity.train(docs, read_table(spark, SF_DIR, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    clean = corpus_pipeline.clean(spark, docs, SF_DIR).cache()
    assert clean.dtypes == columns
    ids = {r["doc_id"] for r in clean.collect()}
    assert ids == {i for i, s in scores.items() if s < 0.5}

    distinct = corpus_pipeline.distinct(spark, clean, SF_DIR).cache()
    last = {}
    for i in sorted(ids):
        last[texts[i]] = i
    ids = {r["doc_id"] for r in distinct.collect()}
    assert distinct.dtypes == columns and ids == set(last.values())

    unlike = corpus_pipeline.unlike(spark, distinct, SF_DIR).cache()
    want = set(components({i: texts[i] for i in ids}, 5).values())
    assert unlike.dtypes == columns and {r["doc_id"] for r in unlike.collect()} == want

    mixed = corpus_pipeline.mixed(spark, unlike, SF_DIR).cache()
    counts = {r["doc_id"]: r["copies"] for r in mixing.replication_counts(unlike).collect() if r["copies"]}
    assert mixed.dtypes == columns and Counter(r["doc_id"] for r in mixed.collect()) == counts

    encoded = corpus_pipeline.encoded(spark, mixed, SF_DIR)
    assert encoded.count() == mixed.count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_awkward_rows(spark):
    docs = frame(spark, awkward_rows())
    assert minhash.drop_near_duplicates(exact_dedup.drop_duplicates(docs, exact_dedup.new_index(spark, 2))).dtypes == docs.dtypes
