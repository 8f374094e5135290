"""Secret scans: candidates from whole texts, false positives removed by a random forest.

A candidate is a run of 16 or more characters ``[A-Za-z0-9+/_-]`` inside a
blank-separated token that has a digit, or of 20 or more without one; a token
can hold several. Words beside it inside the token are its nearest neighbours,
before the tokens around. Features are its length, how its characters change class, how likely its letter pairs
are in ordinary words, how much of it a dictionary covers, the document's path
and the neighbouring tokens. The forest is trained on labelled findings and
decides every candidate of the corpus.

Only DataFrame functions and the JVM's own forest are used. Training takes at
most about ``MAX_LABELLED`` labelled findings, drawn by a hash of the finding.
Everything else sees all rows: the dictionary and the letter pairs are counts
over all texts, without the runs that are long enough to be candidates.

Defined results: null and empty texts have no candidates. A null path counts as
empty. Repeated rows give repeated findings. Without labelled findings of both
classes there is nothing to learn, and every candidate is reported with
probability null and kept for review. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.common import prepare
from rowtide.session import materialize

MAX_LABELLED = 20_000
TREES, DEPTH, HASHED = 20, 6, 32
NEIGHBOURS = 3
RUN = r"[A-Za-z0-9+/_\-]{16,}"

# Words that name credentials, and parts of paths that hold examples.
KEYWORDS = "token|secret|passwd|password|pwd|api_?key|apikey|auth|bearer|credential|private|access"
EXAMPLE_PATHS = "test|example|sample|mock|fixture|doc|readme"


def candidates(docs: DataFrame, path_col: str | None = "source") -> DataFrame:
    """``doc_id, path, place, offset, candidate, before, after, token`` of every candidate.

    ``place`` counts tokens from 0, ``offset`` the characters before the run in
    its token. ``token`` is the token as far as ``NEIGHBOURS`` runs before the
    candidate and behind it, which keeps tokens of many runs from being
    repeated whole; likewise the tokens around come with the ``NEIGHBOURS``
    outermost runs alone, other runs have their neighbours inside.
    """
    prepare(docs.sparkSession)
    path = F.lit("") if path_col is None else F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit(""))
    tokens = F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", -1)
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), path.alias("path"), tokens.alias("tokens"))
    long = F.filter(
        F.transform("tokens", lambda t, i: F.struct(i.alias("place"), t.alias("whole"))),
        lambda c: F.when(F.length(c["whole"]) >= 16, c["whole"].rlike(RUN)).otherwise(False),
    )
    first = F.greatest(F.col("place") - NEIGHBOURS, F.lit(0))
    rows = found.select("doc_id", "path", "tokens", F.inline(long)).select(
        "doc_id",
        "path",
        "place",
        F.slice("tokens", first + 1, F.col("place") - first).alias("ahead"),
        F.slice("tokens", F.col("place") + 2, F.lit(NEIGHBOURS)).alias("behind"),
        F.regexp_extract_all("whole", F.lit(f"({RUN})"), F.lit(1)).alias("runs"),
        F.split("whole", RUN, -1).alias("gaps"),  # one more than runs
        F.when(F.size(F.split("whole", RUN, 3)) > 2, _run_starts(F.col("whole"))).alias("starts"),
    )

    def text(first: Column, stop: Column) -> Column:
        """Gaps from ``first`` to before ``stop``, each with the run behind it."""
        n = F.greatest(stop - first, F.lit(0))
        return F.array_join(F.flatten(F.zip_with(F.slice("gaps", first + 1, n), F.slice("runs", first + 1, n), lambda g, r: F.array(g, r))), "")

    def placed(run: Column, k: Column) -> Column:
        last = F.least(k + 1 + NEIGHBOURS, F.size("runs"))
        return F.struct(
            F.coalesce(F.get("starts", k), F.length(F.get("gaps", F.lit(0)))).alias("offset"),
            run.alias("candidate"),
            F.concat(text(F.greatest(k - NEIGHBOURS, F.lit(0)), k), F.get("gaps", k)).alias("left"),
            F.concat(text(k + 1, last), F.get("gaps", last)).alias("right"),
            (k < NEIGHBOURS).alias("is_first"),
            (k >= F.size("runs") - NEIGHBOURS).alias("is_last"),
        )

    every = F.filter(
        F.transform("runs", placed),
        lambda c: (F.length(c["candidate"]) >= 20) | c["candidate"].rlike("[0-9]"),
    )
    nothing = F.array().cast("array<string>")
    lefts = F.regexp_extract_all("left", F.lit(r"[\p{L}\p{N}_]+[^\p{L}\p{N}_]*|^[^\p{L}\p{N}_]+"), F.lit(0))
    rights = F.regexp_extract_all("right", F.lit(r"[^\p{L}\p{N}_]*[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"), F.lit(0))
    return rows.select("doc_id", "path", "place", "ahead", "behind", F.inline(every)).select(
        "doc_id",
        "path",
        "place",
        "offset",
        "candidate",
        F.concat(F.when(F.col("is_first"), F.col("ahead")).otherwise(nothing), F.reverse(F.slice(F.reverse(lefts), 1, NEIGHBOURS))).alias("before"),
        F.concat(F.slice(rights, 1, NEIGHBOURS), F.when(F.col("is_last"), F.col("behind")).otherwise(nothing)).alias("after"),
        F.concat("left", "candidate", "right").alias("token"),
    )


def _run_starts(token: Column) -> Column:
    """Offsets of the runs of a token, in one pass over its characters."""

    def starts(pair: Column) -> Column:
        c = pair["c"]
        n = F.size(c)
        inside = lambda i: F.coalesce(F.get(c, i) != " ", F.lit(False))
        every = F.sequence(F.lit(0), n - 1)
        opens = F.filter(every, lambda i: inside(i) & ~inside(i - 1))
        closes = F.filter(every, lambda i: inside(i) & ~inside(i + 1))
        long = F.filter(F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["b"] - r["a"] >= 15)
        return F.transform(long, lambda r: r["a"])

    characters = F.split(F.regexp_replace(token, r"[^A-Za-z0-9+/_\-]", " "), "", -1)
    return F.get(F.transform(F.array(F.struct(characters.alias("c"))), starts), F.lit(0))


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings with a ``label`` where rules are sure of it, for corpora without reviewed findings.

    1: assigned, in quotes, to a name of a credential. 0: digits alone, or
    letters alone without such a name nearby. Others carry no label.
    """
    near = F.lower(F.array_join("before", " "))
    assigned = near.rlike(rf"({KEYWORDS})\W*[=:]\W*$") & F.col("token").rlike("[\"']")
    plain = F.col("candidate").rlike("^[0-9]+$") | (F.col("candidate").rlike("^[A-Za-z]+$") & ~near.rlike(KEYWORDS))
    label = F.when(assigned & F.col("candidate").rlike("[0-9]"), 1.0).when(plain, 0.0)
    return found.withColumn("label", label).where("label IS NOT NULL")


def _class_string(candidate: Column) -> Column:
    return F.translate(
        candidate,
        "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-",
        "a" * 26 + "A" * 26 + "0" * 10 + "ssss",
    )


class SecretModel:
    """Features learned from labelled findings, and the forest on them."""

    def __init__(self, words: DataFrame, pairs: DataFrame, forest: RandomForestClassificationModel | None):
        self.words, self.pairs, self.forest = words, pairs, forest

    def features(self, found: DataFrame) -> DataFrame:
        """Append ``features`` to findings that carry ``finding``, an id of their own."""
        letters = F.lower(F.regexp_replace("candidate", "[^A-Za-z]+", " "))
        texts = found.select("candidate").distinct().withColumn("letters", letters)
        runs = texts.select("candidate", F.explode(F.split("letters", " ")).alias("word")).where("length(word) >= 3")
        covered = runs.join(self.words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
        pair_list = F.transform(F.sequence(F.lit(1), F.greatest(F.length("candidate") - 1, F.lit(1))), lambda i: F.lower(F.substring("candidate", i, F.lit(2))))
        pairs = texts.select("candidate", F.explode(pair_list).alias("pair")).join(self.pairs, "pair", "left")
        likely = pairs.groupBy("candidate").agg(F.avg(F.coalesce("log_p", F.lit(-7.0))).alias("pair_log_p"))
        known = texts.select("candidate").join(covered, "candidate", "left").join(likely, "candidate", "left")
        known = materialize(known.withColumnRenamed("candidate", "known_candidate"), "candidate-features")
        n = F.length("candidate").cast("double")
        classes = _class_string(F.col("candidate"))
        changes = lambda a, b: F.size(F.split(classes, rf"(?<={a})(?={b})", -1)) - 1
        near = F.lower(F.array_join("before", " "))
        share = lambda kept: F.length(F.regexp_replace("candidate", kept, "")) / n
        numeric = {
            "len": n,
            "digit_share": share("[^0-9]"),
            "upper_share": share("[^A-Z]"),
            "lower_share": share("[^a-z]"),
            "hex_share": share("[^0-9a-fA-F]"),
            "letter_digit": changes("[aA]", "0") / n,
            "digit_letter": changes("0", "[aA]") / n,
            "case_change": (changes("a", "A") + changes("A", "a")) / n,
            "distinct_share": F.size(F.array_distinct(F.split("candidate", ""))) / n,
            "dictionary": F.coalesce("covered", F.lit(0)) / n,
            "pair_log_p": F.coalesce("pair_log_p", F.lit(0.0)),
            "path_depth": F.size(F.split("path", "/")).cast("double"),
            "path_example": F.lower("path").rlike(EXAMPLE_PATHS).cast("double"),
            "keyword": near.rlike(KEYWORDS).cast("double"),
            "assigned": near.rlike(r"[=:]\W*$").cast("double"),
            "quoted": F.col("token").rlike("[\"'`]").cast("double"),
            "whole_token": (F.length("token") == F.length("candidate")).cast("double"),
        }
        plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", ""))
        named = lambda c: F.filter(F.transform(c, plain), lambda w: w != "")
        words = {
            "before1": F.coalesce(F.get(F.reverse(named("before")), F.lit(0)), F.lit("")),
            "before2": F.coalesce(F.get(F.reverse(named("before")), F.lit(1)), F.lit("")),
            "after1": F.coalesce(F.get(named("after"), F.lit(0)), F.lit("")),
        }
        joined = found.join(known, F.col("candidate") == F.col("known_candidate"), "left")
        wide = joined.select("*", *[v.cast("double").alias(f"f_{k}") for k, v in numeric.items()], *[v.alias(f"w_{k}") for k, v in words.items()])
        hashed = FeatureHasher(inputCols=[f"w_{k}" for k in words], outputCol="f_words", numFeatures=HASHED).transform(wide)
        assembler = VectorAssembler(inputCols=[*[f"f_{k}" for k in numeric], "f_words"], outputCol="features")
        return assembler.transform(hashed).select(*found.columns, "features")

    def decide(self, found: DataFrame) -> DataFrame:
        """Append ``probability`` and ``is_secret``."""
        if self.forest is None:
            return found.withColumn("probability", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
        # written first: the forest then reads plain rows, and no plan holds both its functions and the assembly's
        scored = self.forest.transform(materialize(self.features(found), "assembled"))
        p = F.round(F.get(vector_to_array("class_probability"), F.lit(1)), 9)
        return scored.select(*found.columns, p.alias("probability")).withColumn("is_secret", F.col("probability") >= 0.5)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, count`` of every word of three letters or more, in lower case, outside the runs of ``RUN``."""
    text = F.lower(F.regexp_replace(F.col("text").cast("string"), RUN, " "))
    words = docs.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
    return words.where("length(word) >= 3").groupBy("word").count()


def train(labelled: DataFrame, docs: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7) -> SecretModel:
    """Learn from ``candidates`` rows with ``label`` 0 or 1; at most about ``max_labelled`` are drawn by hash.

    What words and letter pairs are usual is counted over all of ``docs``.
    """
    labelled = materialize(labelled.where("label IS NOT NULL"), "labelled")
    counts = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}  # two rows
    # Both classes get half of the sample, the rarer one as far as it goes.
    draw = (F.pmod(F.xxhash64("doc_id", "place", "candidate"), F.lit(1 << 20)) / float(1 << 20)).cast("double")
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, max_labelled / 2 / n)).otherwise(share)
    sample = materialize(labelled.where(draw < share), "labelled-sample")
    words = materialize(word_counts(docs), "dictionary")
    spelled = words.select("count", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    pairs = spelled.groupBy("pair").agg(F.sum("count").alias("n"))
    total = pairs.agg(F.sum("n")).first()[0] or 1
    pairs = materialize(pairs.select("pair", F.log10(F.col("n") / F.lit(float(total))).alias("log_p")), "letter-pairs")
    model = SecretModel(words.select("word"), pairs, None)
    if len(counts) < 2:
        return model
    rows = materialize(model.features(sample).select("label", "features"), "training-rows")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=seed,
        rawPredictionCol="class_votes", probabilityCol="class_probability", predictionCol="class_predicted",
    )
    model.forest = forest.fit(rows)
    return model


def scan(docs: DataFrame, labelled: DataFrame | None = None, path_col: str | None = "source", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, place, offset, candidate, probability, is_secret`` of every candidate in ``docs``.

    ``labelled`` holds reviewed findings, ``candidates`` rows with a ``label``;
    without them, those of ``docs`` itself that ``weak_labels`` is sure of.
    """
    found = materialize(candidates(docs, path_col), "candidates")
    model = train(weak_labels(found) if labelled is None else labelled, docs, max_labelled)
    return model.decide(found).select("doc_id", "place", "offset", "candidate", "probability", "is_secret")
