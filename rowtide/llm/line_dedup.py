"""Line dedup by content-defined chunks of lines.

Lines are hashed; a rolling hash over the hashes of a line and its
predecessors ends a chunk where it falls into one residue class. Borders thus
depend on nearby lines alone, and text inserted above a shared passage does
not shift the chunks of the passage. A chunk of several lines that occurs more
than once in the corpus keeps its first occurrence, in the order of id and
line; the others are removed after a comparison of the bytes.

Chunks alone find a shared passage of few lines by chance. With ``pairs`` every
line is a border and each two neighbouring lines are a chunk, so that every
shared run of two lines or more is found, wherever it lies in a document; the
removed ranges are then whole runs.

Only DataFrame functions are used. Hashes and places alone are counted first,
with map-side partial counts; the bytes of a repeated chunk's first occurrence
then travel to the other documents that have it, which compare them with their
own. Joins on hashes are merge joins of plain shuffles, so that a hot chunk's
occurrences can be split. Texts are shuffled once.

Defined results: a null text stays null and has no lines; the empty text is a
single line. Single lines and chunks without a letter or digit are never
removed. Documents equal in id and text count as one and keep or lose the same
lines. A null id comes before all others. Chunks that share a hash but not
their bytes stay. A pair that overlaps its first occurrence stays, so each
removed line has an equal one earlier that is kept. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.common import prepare
from rowtide.session import materialize

WINDOW = 2
DIVISOR = 4


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint")


def chunk_ranges(lines: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of ``(start, stop)`` line numbers, 0-based and half open, that covers all lines."""

    def ranges(pair: Column) -> Column:
        hashes = pair["h"]
        n = F.size(hashes)

        def rolling(i: Column) -> Column:
            total = F.lit(0).cast("bigint")
            for back in range(window):
                # the factor keeps swapped lines apart
                total = total + F.coalesce(F.get(hashes, i - back), F.lit(0)) * (2 * back + 1)
            return total

        ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (rolling(i) % divisor == 0) | (i == n - 1))
        starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))

    return F.get(F.transform(F.array(F.struct(F.transform(lines, line_hash).alias("h"))), ranges), F.lit(0))


def chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``doc_id, text_key, start, stop, body`` of every chunk of two lines or more that has a letter or digit."""
    lined = docs.select("doc_id", "text_key", F.split("text", "\n", -1).alias("lines")).where("lines IS NOT NULL")
    cut = lined.select("doc_id", "text_key", "lines", F.inline(chunk_ranges(F.col("lines"), window, divisor)))
    body = F.array_join(F.slice("lines", F.col("start") + 1, F.col("stop") - F.col("start")), "\n")
    several = cut.where("stop - start >= 2").select("doc_id", "text_key", "start", "stop", body.alias("body"))
    return several.where(F.col("body").rlike(r"[\p{L}\p{N}]"))


def line_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, stop, body`` of each two neighbouring lines that have a letter or digit."""
    lined = docs.select("doc_id", "text_key", F.split("text", "\n", -1).alias("lines")).where("size(lines) >= 2")
    both = F.transform(
        F.slice("lines", 1, F.size("lines") - 1),
        lambda line, i: F.struct(i.alias("start"), (i + 2).alias("stop"), F.concat(line, F.lit("\n"), F.get("lines", i + 1)).alias("body")),
    )
    return lined.select("doc_id", "text_key", F.inline(both)).where(F.col("body").rlike(r"[\p{L}\p{N}]"))


def repeated_chunks(whole: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, stop, first_body`` of every chunk that shares its hash with an earlier one."""
    whole = whole.withColumn("hash", F.unhex(F.md5(F.col("body").cast("binary"))))
    whole = whole.withColumn("at", F.struct("doc_id", "text_key", "start"))
    found = materialize(whole.select("hash", "at", "stop"), "chunks")
    first = F.min(F.struct("at", "stop"))
    firsts = found.groupBy("hash").agg(first["at"].alias("first_at"), first["stop"].alias("first_stop"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("hash", "first_at", "first_stop"), "chunk-firsts")
    same_text = F.col("at.doc_id").eqNullSafe(F.col("first_at.doc_id")) & (F.col("at.text_key") == F.col("first_at.text_key"))
    apart = ~same_text | (F.col("at.start") >= F.col("first_stop"))
    again = found.join(firsts.hint("merge"), "hash").where(apart).select("hash", "at", "stop")
    # The comparison, always true, marks the side as a selection, for which Spark filters the chunks by a Bloom filter
    # of the hashes before their texts are shuffled.
    chosen = firsts.where(F.col("hash") >= F.lit(b"")).withColumnRenamed("hash", "first_hash").hint("merge")
    is_first = (F.col("hash") == F.col("first_hash")) & (F.col("at") == F.col("first_at"))
    bodies = whole.join(chosen, is_first).groupBy("hash").agg(F.min("body").alias("first_body"))
    bodies = materialize(bodies, "chunk-bodies")
    return again.join(bodies.hint("merge"), "hash").select("at.doc_id", "at.text_key", "at.start", "stop", "first_body")


def joined_ranges(ranges: Column) -> Column:
    """Ranges in the order of their starts and stops as the runs that they cover together."""

    def joined(pair: Column) -> Column:
        r = pair["r"]
        opens = F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["stop"] < x["start"]))
        closes = F.filter(r, lambda x, i: (i == F.size(r) - 1) | (F.get(r, i + 1)["start"] > x["stop"]))
        return F.zip_with(opens, closes, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop")))

    return F.get(F.transform(F.array(F.struct(ranges.alias("r"))), joined), F.lit(0))


def dedup_lines(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, pairs: bool = False) -> DataFrame:
    """``doc_id, text, n_lines, removed`` per row: the text without repeated chunks, ``removed`` their (start, stop).

    With ``pairs``, chunks are each two neighbouring lines, and ``removed`` holds the runs that they cover.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    whole = line_pairs(rows) if pairs else chunks(rows, window, divisor)
    later = repeated_chunks(whole).distinct().groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "first_body"))).alias("later")
    )
    later = materialize(later.withColumnRenamed("doc_id", "gone_id").withColumnRenamed("text_key", "gone_key"), "chunks-later")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    joined = rows.join(later.hint("merge"), same, "left").withColumn("lines", F.split("text", "\n", -1))
    equal = F.filter(
        "later", lambda r: F.array_join(F.slice(F.col("lines"), r["start"] + 1, r["stop"] - r["start"]), "\n") == r["first_body"]
    )
    ranges = F.transform(equal, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))
    joined = joined.withColumn("removed", F.when(F.size(ranges) > 0, joined_ranges(ranges)).otherwise(ranges) if pairs else ranges)
    # what lies between the removed ranges, each line touched once
    befores = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["stop"]))
    afters = F.concat(F.transform("removed", lambda r: r["start"]), F.array(F.size("lines")))
    gaps = F.zip_with(befores, afters, lambda a, b: F.slice(F.col("lines"), a + 1, b - a))
    kept = F.array_join(F.flatten(gaps), "\n")
    return joined.select(
        "doc_id",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<struct<start:int,stop:int>>")).alias("removed"),
    )
