"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of the output size
over its own size. A document's count is the inverse of the Poisson
distribution with that mean at a uniform number hashed from seed and id, so a
re-run, a retry and any partitioning give the same counts. Each document is
exploded by its count and the copies are put into one global random order.

A source's distribution function is one array per source, long as its rate
asks for. Sizes are summed before the shuffle; the per-source rows are written
first so that their size is known when Spark picks the join, and the join on a
hot source is one that can be split.

Defined results: a null source is a source of its own; a source without a
target weight gets weight 0; sources of size 0 take no part in the shares. A
null text has size 0. Rows with equal ids get equal counts; a null id is
hashed as the empty text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.common import prepare, with_position
from rowtide.session import materialize

SEED = 20
TEMPERATURE = 0.5


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _rates(docs: DataFrame, weights: Mapping[str | None, float] | None, temperature: float, epochs: float) -> DataFrame:
    """``source, rate``: mean repetitions that give each source its share of ``epochs`` times the input's size."""
    size = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("bigint")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size")).where("size > 0")
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sizes = materialize(sizes.withColumn("weight", weight), "sources")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()  # two numbers
    if not total["weight"]:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(float(total["weight"]))
    return sizes.select("source", (F.lit(float(epochs)) * share * (F.lit(float(total["size"])) / F.col("size"))).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... up to far in the tail, where nothing is left to 52 bits."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    # log P(k) = log P(k - 1) + log(rate / k) stays finite for large rates
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def add(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate / k)
        total = state["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.array_append(state["all"], total).alias("all"))

    return F.when(rate > 0, F.reduce(F.sequence(F.lit(1), last), start, add)["all"]).otherwise(F.array().cast("array<double>"))


def replication_counts(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
    seed: int = SEED,
    carry: bool = False,
) -> DataFrame:
    """``doc_id, source, rate, copies`` per row; with ``carry`` also ``row``, the whole row as a struct.

    ``weights`` are target shares of the output's bytes; without them a source
    weighs its size to the power ``temperature``.
    """
    prepare(docs.sparkSession)
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    whole = [F.struct(*columns.values()).alias("row")] if carry else []
    rows = docs.select(columns["doc_id"].cast("bigint").alias("doc_id"), columns["source"].cast("string").alias("source"), *whole)
    sized = docs.select(columns["source"].cast("string").alias("source"), columns["text"].cast("string").alias("text"))
    rates = _rates(sized, weights, temperature, epochs).withColumn("cdf", _distribution(F.col("rate")))
    rates = materialize(rates.withColumnRenamed("source", "rate_source"), "rates")
    joined = rows.join(rates, F.col("source").eqNullSafe(F.col("rate_source")), "left")
    u = uniform(F.col("doc_id"), seed)
    copies = F.when(F.coalesce(F.size("cdf"), F.lit(0)) <= 0, F.lit(0)).otherwise(
        F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    )
    return joined.withColumn("u", u).select(
        "doc_id", "source", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.cast("int").alias("copies"), *(["row"] if carry else [])
    )


def shuffle_key(seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("copy").cast("string"))
    return F.md5(text.cast("binary"))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``doc_id, source, copies, copy, position``: each document by its count, in a global random order."""
    counted = replication_counts(docs, seed=seed, **options).where("copies > 0")
    copies = counted.select("doc_id", "source", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    keyed = copies.withColumn("mix_key", shuffle_key(seed))
    placed, _ = with_position(keyed, ["mix_key", "doc_id", "copy", "source"], "position", "mixed")
    return placed.select("doc_id", "source", "copies", "copy", "position")


def mixed_rows(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The replicated documents themselves, columns unchanged, sorted by the random key over all partitions."""
    counted = replication_counts(docs, seed=seed, carry=True, **options).where("copies > 0")
    copies = counted.select("doc_id", "row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    keyed = copies.withColumn("mix_key", shuffle_key(seed))
    return keyed.repartitionByRange("mix_key", "copy").sortWithinPartitions("mix_key", "copy").select("row.*")
