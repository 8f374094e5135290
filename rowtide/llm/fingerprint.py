"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch retains every hash of a shingle (five words) that lies below a fixed
fraction of the hash range, whatever the document's length, so sketches can be
merged, and containment and likeness of very unequal documents be estimated
from them. The smallest hash is always kept as well, so that no text with a
word has an empty sketch; a merge keeps this law.

Hashes are computed in Arrow batches with numpy; nothing is gathered per group.

Defined results: a null text counts as empty. Texts of fewer than five words
have their whole sequence as the one shingle; a text without words has the
empty sketch, which is like another empty sketch (1) and unlike any other (0).
Equal texts have equal fingerprints. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtide.llm.common import id_and_text, prepare, shingle_hashes, word_hashes

WORDS = 5
FRACTION = 1 / 8
DIGITS = 12  # hex digits of a hash that a fingerprint shows
RANGES_PER_PARTITION = 4


def retain(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct hashes below the fraction, and the smallest of all."""
    if hashes.size == 0:
        return hashes
    below = np.unique(hashes[hashes < np.uint64(int(fraction * 2**64))])
    return below if below.size else np.array([hashes.min()], dtype=np.uint64)


def sketch(text: str | bytes, words: int = WORDS, fraction: float = FRACTION) -> np.ndarray:
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, dtype=np.uint8)
    hashed, _ = word_hashes(data, np.array([0, data.size]), lower=False)
    return retain(shingle_hashes(hashed, words) >> np.uint64(64 - 4 * DIGITS) << np.uint64(64 - 4 * DIGITS), fraction)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    return retain(np.concatenate((a, b)), fraction)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among those of either."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    common = np.intersect1d(a, b, assume_unique=True).size
    return common / (a.size + b.size - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    return np.intersect1d(a, b, assume_unique=True).size / a.size if a.size else 1.0


def to_text(hashes: np.ndarray) -> str:
    """Each hash as ``DIGITS`` hex digits, in ascending order."""
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : DIGITS // 2]
    return raw.tobytes().hex()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), dtype=np.uint8).reshape(-1, DIGITS // 2)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, : DIGITS // 2] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return pd.Series([to_text(sketch(t, words, fraction)) for t in texts])

    return id_and_text(docs).select("doc_id", shown("text").alias("fingerprint"))


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Each document against an edited form of itself and against the next one by id.

    The edited text has its last half replaced by the beginning of the next
    document (of the first one for the last). Rows are dealt by ranges of ids;
    the first document of a range is also sent to the range before, where it
    ends it. Texts are shuffled once, and a task streams through its ranges.
    Equal ids are ordered by a hash of the text; a null id comes first.
    """
    spark = prepare(docs.sparkSession)
    rows = id_and_text(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Borders are ids that occur: as many numbers as there are ranges, whatever the table's size.
    ends = rows.agg(
        F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("borders"), F.min("at").alias("first")
    ).first()
    first = ends["first"]
    borders = sorted(set(ends["borders"] or []) - {first})
    of_range = F.size(F.filter(F.lit(borders), lambda b: b <= F.col("at"))) if borders else F.lit(0)
    starts = F.col("at").isin(borders) if borders else F.lit(False)
    here = F.struct(of_range.alias("range"), F.lit(False).alias("is_end"))
    before = F.struct((of_range - 1).alias("range"), F.lit(True).alias("is_end"))
    last = F.struct(F.lit(len(borders)).alias("range"), F.lit(True).alias("is_end"))
    targets = F.array(here, F.when(F.col("at") == F.lit(first), last).when(starts, before))
    dealt = rows.select("doc_id", "at", "text", F.inline(F.filter(targets, lambda t: t.isNotNull())))
    ordered = (
        dealt.withColumn("tie", F.xxhash64("text"))
        .repartition("range")
        .sortWithinPartitions("range", "is_end", "at", "tie", "text")
        .select("range", "is_end", "doc_id", "text")
    )

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (range, id, text, sketch) whose successor has not come yet
        for batch in batches:
            out = []
            for rng, is_end, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = sketch(text, words, fraction)
                if waiting is not None and waiting[0] == rng:
                    out.append(_compare(*waiting[1:], text, own, words, fraction))
                waiting = None if is_end else (rng, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return ordered.mapInArrow(paired, RESULT)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compare(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray, words: int, fraction: float) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = sketch(edited, words, fraction)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": to_text(own),
        "edited_fingerprint": to_text(changed),
        "near_edited": likeness(own, changed),
        "near_next": likeness(own, other),
    }
