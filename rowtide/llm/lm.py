"""Language-model scores from a weighted backoff automaton.

The model's n-grams are words and pairs of words. A word seen in training is a
state; a seen pair is an arc out of its first word's state, weighted with its
smoothed log-probability; every state has a failure arc to the root, weighted
with the mass left for pairs not seen, and the root has an arc for every word.
One traversal from the left carries the state through a text and adds weights.

Smoothing mixes two of Dirichlet's, a weak and a strong one, each of the form
P(w | h) = (c(hw) + m P(w)) / (c(h) + m) with the unigrams
P(w) = (c(w) + 1/2) / (N + (V + 1) / 2), which sum to one over the vocabulary
and one unknown word. Of a few mixtures the one is taken that gives the
training texts the highest likelihood with each token left out of its own
counts.

No task ever holds the model. Documents are dealt into blocks of bounded size;
a block asks for the counts of the distinct n-grams it has, as sorted hashes
cut into buckets, and hands in its own training counts with the question. A
bucket sums what all blocks hand in and answers each. The block then has the
part of the automaton that its texts traverse. Hot words are one entry per
block. The number of blocks and buckets follows the input's bytes.

Words are known by 64-bit hashes. Defined results: a null text counts as
empty and consists of the end token alone. Repeated rows are scored alike and
counted as often as they occur; a null id is part of training. Without
training texts every token has the unigram probability of an unknown word.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.common import buffers, id_and_text, mix, prepare, word_hashes
from rowtide.session import materialize

BLOCK_BYTES = 8 << 20
# Mixtures to choose from, each as (share, strength m) of its parts.
SMOOTHINGS = tuple(
    ((share, weak), (1 - share, strong)) for weak in (3.0, 30.0) for strong in (3e4, 1e6) for share in (0.3, 0.5)
)
Smoothing = tuple[tuple[float, float], ...]
TOKENS_AT_ONCE = 1 << 21
START, END = (np.uint64(x) for x in mix(np.array([0x57A27, 0xE4D], dtype=np.uint64)))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, an end after each text's; and the texts' offsets in them."""
    words, ends = word_hashes(*buffers(column), lower=True)
    starts = ends + np.arange(len(ends))
    tokens = np.full(starts[-1], END, dtype=np.uint64)
    inside = np.ones(len(tokens), dtype=bool)
    inside[starts[1:] - 1] = False
    tokens[inside] = words
    return tokens, starts


def histories_of(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = START
    return before


def pair_keys(histories: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(histories * np.uint64(0x9E3779B97F4A7C15) + tokens)


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct numbers as the first one and six or eight bytes for each step."""
    steps = np.diff(keys)
    wide = bool(steps.size and steps.max() >= np.uint64(1 << 48))
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([wide]) + keys[:1].astype("<u8").tobytes() + (raw if wide else raw[:, :6]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    width = 8 if packed[0] else 6
    raw = np.frombuffer(packed, dtype=np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw), 8), dtype=np.uint8)
    steps[:, :width] = raw
    first = np.frombuffer(packed, dtype="<u8", count=1, offset=1)
    return np.cumsum(np.concatenate((first, steps.reshape(-1).view("<u8"))), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max(initial=0))).newbyteorder("<")
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1).astype(np.int64)


def bucket_borders(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of each bucket's keys among sorted ``keys``; buckets are equal ranges of the high bits."""
    of_key = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of_key, np.arange(buckets + 1, dtype=np.uint64))


def distinct_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their weights (how often they occur, without weights)."""
    if weights is None:
        ordered = np.sort(keys)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if ordered.size else np.zeros(0, dtype=np.int64)
        return ordered[first], np.diff(np.append(first, ordered.size))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if ordered.size else np.zeros(0, dtype=np.int64)
    return ordered[first], np.add.reduceat(weights[order], first) if first.size else np.zeros(0, dtype=np.int64)


def _slices(keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    borders = bucket_borders(keys, buckets)
    for bucket in np.flatnonzero(np.diff(borders)):
        a, b = borders[bucket], borders[bucket + 1]
        yield int(bucket), pack(keys[a:b]), pack_counts(counts[a:b])


def corpus_totals(training: DataFrame, buckets: int) -> tuple[int, int, int]:
    """Tokens, distinct tokens and texts of the training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def flush() -> pa.RecordBatch:
            keys, counts = distinct_counts(np.concatenate(held))
            rows = list(_slices(keys, counts, buckets))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([int(counts.sum())] + [0] * (len(rows) - 1), pa.int64()), pa.array([texts] + [0] * (len(rows) - 1), pa.int64())],
                names=["bucket", "keys", "tokens", "texts"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(tokens_of(batch.column(0))[0])
                size, texts = size + len(held[-1]), texts + batch.num_rows
            if size >= TOKENS_AT_ONCE:
                yield flush()
                held, size, texts = [], 0, 0
        if held:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(k) for k in group.column("keys").to_pylist()])
        return pa.table({"words": [len(distinct_counts(keys)[0])], "tokens": [sum(group.column("tokens").to_pylist())], "texts": [sum(group.column("texts").to_pylist())]})

    counted = training.select("text").mapInArrow(count, "bucket int, keys binary, tokens bigint, texts bigint")
    merged = counted.groupBy("bucket").applyInArrow(merge, "words bigint, tokens bigint, texts bigint")
    total = merged.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "texts")]).first()
    return tuple(total)


class BackoffAutomaton:
    """The states and arcs that a block of texts traverses, as arrays over its distinct n-grams."""

    def __init__(self, counts: np.ndarray, totals: tuple[int, int, int]):
        self.counts, (self.tokens, self.words, self.texts) = counts, totals

    def root(self, word_count: np.ndarray, left_out: int = 0) -> np.ndarray:
        """Probability of a word from the root."""
        return (word_count + (0.5 - left_out)) / (self.tokens - left_out + 0.5 * (self.words + 1))

    def traverse(self, word: np.ndarray, state: np.ndarray, arc: np.ndarray, smoothing: Smoothing, left_out: int = 0) -> np.ndarray:
        """log10 weight of each step: the arc where the pair was seen, else the failure arc and the root's arc.

        ``word``, ``state`` and ``arc`` are how often the token, the history
        and the pair were seen in training.
        """
        history, seen, root = state - left_out, arc - left_out, self.root(word, left_out)
        taken = np.flatnonzero(seen > 0)
        failure, along = np.zeros(len(root)), np.zeros(len(taken))
        for share, strength in smoothing:
            failure += share * strength / (history + strength)
            along += share * (seen[taken] + strength * root[taken]) / (history[taken] + strength)
        weights = failure * root
        weights[taken] = along
        return np.log10(weights)


def _requests(training: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, histories, pairs and text offsets of a block; its distinct n-grams and their training counts."""
    tokens, starts = tokens_of(texts)
    histories = histories_of(tokens, starts)
    pairs = pair_keys(histories, tokens)
    trained = np.repeat(training, np.diff(starts)).astype(np.int64)
    keys, counts = distinct_counts(np.concatenate((tokens, pairs)), np.concatenate((trained, trained)))
    return tokens, histories, pairs, starts, keys, counts


def score_texts(docs: DataFrame, train_on: Column, smoothings: tuple[Smoothing, ...] = SMOOTHINGS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``train_on`` says from ``doc_id`` which rows to learn from.
    """
    spark = prepare(docs.sparkSession)
    rows = id_and_text(docs).withColumn("training", train_on)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    totals = corpus_totals(rows.where("training"), blocks)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    blocked = rows.select(block.alias("block"), "doc_id", "training", "text").groupBy("block")

    def ask(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        *_, keys, counts = _requests(group.column("training").to_numpy(zero_copy_only=False), group.column("text").combine_chunks())
        rows = list(_slices(keys, counts, blocks))
        return pa.table(
            {"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([group.column("block")[0].as_py()] * len(rows), pa.int32()),
             "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())}
        )

    def answer(group: pa.Table) -> pa.Table:
        keys = [unpack(k) for k in group.column("keys").to_pylist()]
        joined = np.concatenate(keys)
        distinct, sums = distinct_counts(joined, np.concatenate([unpack_counts(c) for c in group.column("counts").to_pylist()]))
        replies = [pack_counts(sums[np.searchsorted(distinct, k)]) for k in keys]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "totals": pa.array(replies, pa.binary())})

    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        training = texts.column("training").to_numpy(zero_copy_only=False).astype(bool)
        tokens, histories, pairs, starts, keys, _ = _requests(training, texts.column("text").combine_chunks())
        ordered = sorted(zip(replies.column("bucket").to_pylist(), replies.column("totals").to_pylist(), strict=True))
        counts = np.concatenate([unpack_counts(t) for _, t in ordered])
        automaton = BackoffAutomaton(counts, totals)
        word, arc = counts[np.searchsorted(keys, tokens)], counts[np.searchsorted(keys, pairs)]
        state = np.full(len(tokens), totals[2], dtype=np.int64)  # the start's
        state[1:] = np.where(histories[1:] == START, totals[2], word[:-1])
        per_text = lambda x: np.add.reduceat(x, starts[:-1])
        scores = np.stack([per_text(automaton.traverse(word, state, arc, m)) for m in smoothings], axis=1)
        own = np.repeat(training, np.diff(starts))
        left_out = np.zeros((len(training), len(smoothings)))
        if own.any():
            for i, m in enumerate(smoothings):
                steps = np.zeros(len(tokens))
                steps[own] = automaton.traverse(word[own], state[own], arc[own], m, left_out=1)
                left_out[:, i] = per_text(steps)
        return pa.table(
            {"doc_id": texts.column("doc_id"), "n_tokens": pa.array(np.diff(starts), pa.int64()), "n_known": pa.array(per_text((word > 0).astype(np.int64)), pa.int64()),
             "base_score": per_text(np.log10(automaton.root(word))), "scores": pa.array(list(scores), pa.list_(pa.float64())), "left_out": pa.array(list(left_out), pa.list_(pa.float64()))}
        )

    asked = blocked.applyInArrow(ask, "bucket int, block int, keys binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, totals binary")
    scored = blocked.cogroup(answered.groupBy("block")).applyInArrow(
        score, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, scores array<double>, left_out array<double>"
    )
    scored = materialize(scored, "lm-scores")
    sums = scored.agg(*[F.sum(F.get("left_out", F.lit(i))) for i in range(len(smoothings))]).first()
    best = max(range(len(smoothings)), key=lambda i: sums[i] or 0.0)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(totals[0]).cast("bigint").alias("train_tokens"), "base_score", F.get("scores", F.lit(best)).alias("score")
    )
