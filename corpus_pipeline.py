"""From ``documents`` to encoded training rows: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm import bpe, exact_dedup, minhash, mixing, toxicity
from rowtide.llm.common import prepare, read_table
from rowtide.llm.queries import vocabulary_path
from rowtide.session import materialize


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model of all labels."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text."""
    return exact_dedup.drop_duplicates(docs, exact_dedup.new_index(prepare(spark)))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group linked by shingles of five words at a similarity of 0.8 or more."""
    prepare(spark)
    return minhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to shares of the square root of their source's bytes, in a random order."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of every row that was mixed in."""
    prepare(spark)
    content = bpe.read_vocabulary(vocabulary_path())
    columns = [F.col(c) for c in ("doc_id", "source")]
    with_ids = docs.select(*columns, bpe.encode_column(docs, content, F.col("text").cast("string")).alias("ids"))
    return with_ids.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mixing", mixed),
    ("bpe", encoded),
]

# Toxicity, near-dedup and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
