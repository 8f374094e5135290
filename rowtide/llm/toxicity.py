"""Toxicity by maximum-scoring segments of token log-odds.

Every token gets the log-odds of standing in toxic rather than other documents,
shrunken by an informative Dirichlet prior: a token's prior is the estimate of
its beginning, that one's the beginning one letter shorter, and so on up to the
share of toxic documents. Rare tokens so take the score of what they begin
with, and what is frequent speaks for itself. A token whose log-odds is within
``TOLERANCE`` of what it inherits is not stored and inherits it.

One linear scan adds the scores along a text and finds every maximal segment
(Ruzzo and Tompa's algorithm); a negative drift per token keeps segments local.
Scores of the best segments of clean training texts follow an extreme-value law
whose two parameters, taken from quantiles that outliers do not move, turn a
document's segments into p-values; a logistic curve on their evidence gives the
probability. The best segment always counts, others when they are significant.

Training draws at most about ``MAX_LABELLED`` labelled documents by a hash of
the id; token counts, model and calibration come from them and are bounded by
that number. Scoring is one pass over whole texts, without any shuffle.

Defined results: tokens are what white space parts, in lower case and without
signs at their ends; digits and signs within stay, so joined spellings are
tokens of their own. Null and empty texts get the score of a text without
evidence. A document labelled twice counts as toxic if any label says so; null
labels and ids are left out of training. Rows are scored alone: repeated rows
get equal scores, other columns are not read. Without labels of both classes
every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.common import id_and_text, prepare, where_row
from rowtide.session import materialize

MAX_LABELLED = 100_000
PREFIXES = range(4, 9)
PRIOR = 30.0  # documents' weight of what a token inherits
TOLERANCE = 0.5  # of natural log-odds
DRIFT = -0.25
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
REMEMBERED = 300_000
BINS = 400
SIGNIFICANT = -math.log10(0.05)
LOW, HIGH = 0.25, 0.9  # quantiles that the extreme-value law is fitted on


def token(raw: str) -> str:
    return EDGES.sub("", raw)


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first token, last token)``, in linear time.

    ``places`` are the tokens with a score of their own, ascending; every
    other token scores ``drift``, which is not positive.
    """
    stack: list[list[float]] = []  # left sum, right sum, first, last
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total += drift * (place - at)
        at = place + 1
        left, total = total, total + score
        if score <= 0:
            continue
        new = [left, total, place, place]
        while True:
            j = len(stack) - 1
            # the nearest earlier segment that starts below this one
            while j >= 0 and stack[j][0] >= new[0]:
                j = int(stack[j][4])
            if j < 0 or stack[j][1] >= new[1]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(s[1] - s[0], int(s[2]), int(s[3])) for s in stack]


@dataclass
class ToxicityModel:
    log_odds: dict[str, float] = field(default_factory=dict)
    location: float = 0.0
    scale: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0

    def token_score(self, word: str) -> float | None:
        """Of the most specific that is stored of the token and its beginnings."""
        beginnings = (word[:n] for n in reversed(PREFIXES) if n <= len(word))
        return next((self.log_odds[f] for f in (f"={word}", *beginnings) if f in self.log_odds), None)

    def passages(self, text: str, known: dict[str, float | None]) -> tuple[list[tuple[float, int, int]], int]:
        """Scored segments and number of tokens; ``known`` remembers tokens."""
        words = text.lower().split()
        places, scores = [], []
        for i, word in enumerate(words):
            score = known.get(word, 0)
            if score == 0:
                if len(known) > REMEMBERED:
                    known.clear()
                score = self.token_score(token(word))
                # every token bears the drift
                score = known[word] = None if score is None else score + DRIFT
            if score is not None:
                places.append(i)
                scores.append(score)
        return segments(places, scores, DRIFT), len(words)

    def surprise(self, score: float, tokens: int) -> float:
        """-log10 of the p-value of a segment among those of as long clean texts.

        The best segment expected grows with the logarithm of the length, so
        longer texts need more.
        """
        z = (score - math.log(max(tokens, 1)) - self.location) / self.scale
        p = -math.expm1(-math.exp(-max(min(z, 600.0), -6.0)))
        return -math.log10(max(p, 1e-12))

    def evidence(self, found: list[tuple[float, int, int]], tokens: int) -> float:
        """Surprise of the best segment, and of all others that are significant at 0.05."""
        each = sorted((self.surprise(score, tokens) for score, _, _ in found), reverse=True)
        return sum(each[:1]) + sum(e for e in each[1:] if e > SIGNIFICANT)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(min(self.intercept + self.slope * evidence, 40.0), -40.0)))


def _counted(labelled: DataFrame) -> DataFrame:
    """``word, toxic, other``: labelled documents of each class that have the word."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(part["text"], part["label"], strict=True):
                seen[label].update({token(w) for w in text.lower().split()})
            words = [w for w in seen[0] | seen[1] if w]
            yield pd.DataFrame({"word": words, "toxic": [seen[1][w] for w in words], "other": [seen[0][w] for w in words]})

    partial = labelled.select("text", "label").mapInPandas(count, "word string, toxic bigint, other bigint")
    return partial.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _shrunken(words: DataFrame, base: float) -> DataFrame:
    """``feature, log_odds`` of what is stored: ``=token`` or a beginning. ``base`` is the share of toxic documents."""
    apart = math.log(base / (1 - base))

    def estimated(counts: DataFrame) -> DataFrame:
        """``counts`` has ``feature, toxic, other`` and, null at the top, ``prior`` and ``inherited``."""
        prior, inherited = F.coalesce("prior", F.lit(base)), F.coalesce("inherited", F.lit(0.0))
        p = (F.col("toxic") + PRIOR * prior) / (F.col("toxic") + F.col("other") + PRIOR)
        rows = counts.select("feature", p.alias("p"), (F.log(p / (1 - p)) - apart).alias("log_odds"), inherited.alias("inherited"))
        stored = F.abs(F.col("log_odds") - F.col("inherited")) >= TOLERANCE
        return rows.select("feature", "p", F.when(stored, F.col("log_odds")).otherwise(F.col("inherited")).alias("log_odds"), stored.alias("stored"))

    above = None
    for n in PREFIXES:
        counts = words.where(F.length("word") >= n).groupBy(F.substring("word", 1, n).alias("feature")).agg(
            F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        level = materialize(estimated(_with_prior(counts, above, F.substring("feature", 1, n - 1))), "beginnings")
        above = level if above is None else above.unionByName(level)
    whole = _with_prior(words.withColumnRenamed("word", "feature"), above, F.substring("feature", 1, PREFIXES[-1]))
    whole = estimated(whole).withColumn("feature", F.concat(F.lit("="), "feature"))
    return above.unionByName(whole).where("stored").select("feature", "log_odds")


def _with_prior(counts: DataFrame, above: DataFrame | None, parent: Column) -> DataFrame:
    """Append the estimate of each feature's ``parent``."""
    if above is None:
        return counts.withColumns({"prior": F.lit(None).cast("double"), "inherited": F.lit(None).cast("double")})
    known = above.select(F.col("feature").alias("above"), F.col("p").alias("prior"), F.col("log_odds").alias("inherited"))
    return counts.withColumn("parent", parent).join(known, F.col("parent") == F.col("above"), "left")


def _logistic(evidence: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method on counted bins, with a light pull to zero."""
    x = np.stack([np.ones_like(evidence), evidence])
    n, w = toxic + other, np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        gradient = x @ (toxic - n * p) - 1e-3 * w
        hessian = (x * (n * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learn from documents with a label in ``labels`` (``doc_id, toxic``)."""
    spark = prepare(docs.sparkSession)
    given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    given = given.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    given = materialize(given, "labels")
    share = max_labelled / max(given.count(), 1)
    if share < 1:
        given = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most about max_labelled rows of two numbers.
    labelled = materialize(id_and_text(docs).join(F.broadcast(given), "doc_id").select("text", "label"), "labelled")
    totals = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    toxic_docs, other_docs = totals.get(1, 0), totals.get(0, 0)
    if not toxic_docs or not other_docs:
        p = toxic_docs / max(toxic_docs + other_docs, 1)
        return ToxicityModel(intercept=math.log(max(p, 1e-9) / max(1 - p, 1e-9)))
    stored = _shrunken(materialize(_counted(labelled), "token-counts"), toxic_docs / (toxic_docs + other_docs))
    # bounded by the number of labelled documents
    model = ToxicityModel({r["feature"]: r["log_odds"] for r in stored.toLocalIterator()})
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("best double, all array<double>, tokens int")
    def scan(texts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for text in texts:
            found, tokens = shipped.value.passages(text, known)
            scores = [s for s, _, _ in found]
            rows.append((max(scores, default=0.0) - math.log(max(tokens, 1)), scores, tokens))
        return pd.DataFrame(rows, columns=["best", "all", "tokens"])

    scanned = materialize(labelled.select("label", scan("text").alias("s")).select("label", "s.*"), "segments")
    low, high = scanned.where("label = 0").agg(F.percentile_approx("best", [LOW, HIGH], 10_000)).first()[0]
    gumbel = [-math.log(-math.log(q)) for q in (LOW, HIGH)]
    model.scale = max((high - low) / (gumbel[1] - gumbel[0]), 0.05)
    model.location = low - gumbel[0] * model.scale

    @F.pandas_udf("double")
    def evidence(scores: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([calibrated.value.evidence([(s, 0, 0) for s in all_], n) for all_, n in zip(scores, tokens, strict=True)])

    calibrated = spark.sparkContext.broadcast(model)
    bins = scanned.select("label", F.least(F.round(evidence("all", "tokens") * 4), F.lit(float(BINS))).alias("bin"))
    counted = bins.groupBy("bin").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).toPandas()  # at most BINS rows
    model.intercept, model.slope = _logistic(
        counted["bin"].to_numpy(float) / 4, counted["toxic"].to_numpy(float), (counted["n"] - counted["toxic"]).to_numpy(float)
    )
    return model


def score_column(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """Struct of ``score`` and ``passages``, the significant segments as (score, first token, last token)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<score:double,first:int,last:int>>")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, known = shipped.value, {}
        for texts in parts:
            rows = []
            for t in texts:
                found, tokens = model.passages(t or "", known)
                sure = [s for s in found if model.surprise(s[0], tokens) > SIGNIFICANT]
                rows.append((model.probability(model.evidence(found, tokens)), [{"score": s, "first": a, "last": b} for s, a, b in sure]))
            yield pd.DataFrame(rows, columns=["score", "passages"])

    return scored(text)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, passages`` of every row."""
    prepare(docs.sparkSession)
    return id_and_text(docs).select("doc_id", score_column(docs, model, F.col("text")).alias("s")).select("doc_id", "s.*")


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` below the threshold, unchanged."""
    prepare(docs.sparkSession)
    return where_row(docs, score_column(docs, model, F.col("text").cast("string"))["score"] < threshold)
