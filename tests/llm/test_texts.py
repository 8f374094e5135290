"""BPE, fingerprints, toxicity, language model and secrets against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rowtide.llm import bpe, fingerprint, lm, secrets, toxicity
from rowtide.llm.common import held_out
from rowtide.llm.queries import vocabulary_path
from tests.llm.helpers import SCHEMA, awkward_rows, frame, text_of, words_of

VOCABULARY = vocabulary_path()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.one_of(
    st.text(alphabet="abeinrst'éßΣσİ 日12.!?<|>\n\x1c\xa0́", max_size=40),
    st.text(alphabet="an", max_size=60),
    st.sampled_from(["<|endoftext|>", "a<|startoftext|>B <|endoftext|", "I'LL they're 's"]),
))
def test_bpe_equals_library(library, text):
    encoder = bpe._encoder(bpe.read_vocabulary(VOCABULARY))
    ids = np.frombuffer(encoder.encode(text), dtype="<u4")
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert b"".join(encoder.vocabulary.decode(ids)).decode() == library.decode(want, skip_special_tokens=False)


@needs_vocabulary
def test_bpe_rows(spark, library):
    rows = awkward_rows()
    content = bpe.read_vocabulary(VOCABULARY)
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe.round_trip_digests(docs, content).collect()}
    want = set()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((r[0], hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), len(ids)))
    assert got == want
    encoded = docs.select("text", bpe.encode_column(docs, content, docs["text"]).alias("ids"))
    for r in encoded.withColumn("back", bpe.decode_column(docs, content, encoded["ids"])).collect():
        assert r["back"] == library.decode(library.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_sketches():
    rng = random.Random(2)
    a, b = text_of(rng, 3000), text_of(rng, 2000)
    x, y = fingerprint.sketch(a), fingerprint.sketch(b)
    assert (fingerprint.from_text(fingerprint.to_text(x)) == x).all()
    both = fingerprint.merge(x, y)
    assert fingerprint.containment(x, both) == 1.0 and fingerprint.likeness(x, y) < 0.01
    part = fingerprint.sketch(" ".join(a.split()[:300]))
    assert fingerprint.containment(part, x) > 0.95 and abs(fingerprint.likeness(part, x) - 0.1) < 0.04
    assert fingerprint.sketch("").size == 0 and fingerprint.sketch("one").size == 1
    assert fingerprint.likeness(fingerprint.sketch(""), fingerprint.sketch(" ")) == 1.0
    assert fingerprint.likeness(fingerprint.sketch(""), fingerprint.sketch("a")) == 0.0


def test_edited_pairs(spark):
    rows = [r for r in awkward_rows() if r[0] is not None][:-2]  # distinct ids
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: r[0])
    assert len(got) == len(rows)
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = fingerprint.sketch(text)
        assert got[r[0]]["n_chars"] == len(text)
        assert got[r[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[r[0]]["fingerprint"] == fingerprint.to_text(own)
        assert got[r[0]]["near_edited"] == fingerprint.likeness(own, fingerprint.sketch(edited))
        assert got[r[0]]["near_next"] == fingerprint.likeness(own, fingerprint.sketch(following))
    # repeated ids and null ids: every row has one result
    assert fingerprint.edited_pairs(frame(spark, awkward_rows())).count() == len(awkward_rows())


def best_segments(scores):
    """All maximal segments by their recursive definition."""

    def search(a, b):
        best, at = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                shorter = at is not None and abs(total - best) < 1e-9 and j - i < at[1] - at[0]
                if total > best + 1e-9 or shorter:
                    best, at = total, (i, j)
        return [] if at is None else [*search(a, at[0]), (round(best, 9), *at), *search(at[1] + 1, b)]

    return search(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 25), st.floats(-2, 2).map(lambda x: round(x, 3)), max_size=20))
def test_segments(scored):
    places = sorted(scored)
    plain = [-0.3] * (max(places, default=-1) + 1)
    for p in places:
        plain[p] = scored[p]
    got = toxicity.segments(places, [scored[p] for p in places], -0.3)
    assert sorted((round(s, 9), a, b) for s, a, b in got) == sorted(best_segments(plain))


def toxic_corpus(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = text_of(rng, rng.randrange(20, 120)).split()
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["badword", "vileness", "vilenessful", "nasty"]))
        rows.append((i, " ".join(words), *[None] * 9))
        labels.append((i, int(toxic)))
    return rows, labels


def plain_log_odds(texts, labels):
    """What ``toxicity.train`` stores, from its definition."""
    base = sum(labels) / len(labels)
    words = [{toxicity.EDGES.sub("", w) for w in t.lower().split()} - {""} for t in texts]
    counts = {}
    for found, toxic in zip(words, labels, strict=True):
        for w in found:
            for f in {"=" + w} | {w[:n] for n in range(4, 9) if len(w) >= n}:
                if f.startswith("="):
                    counts.setdefault(f, [0, 0])[toxic] += 1
            for n in range(4, 9):
                if len(w) >= n:
                    counts.setdefault(w[:n], [0, 0])[toxic] += 1

    def estimate(f):
        if len(f) < 4:
            return base, 0.0, False
        whole = f.startswith("=")
        if not whole and f not in counts:
            return base, 0.0, False
        if whole:
            parent = f[1:][:8]
        else:
            parent = f[:-1]
        p, inherited, _ = estimate(parent) if not parent.startswith("=") else (base, 0.0, False)
        p = (counts[f][1] + toxicity.PRIOR * p) / (sum(counts[f]) + toxicity.PRIOR)
        score = math.log(p / (1 - p)) - math.log(base / (1 - base))
        stored = abs(score - inherited) >= toxicity.TOLERANCE
        return p, score if stored else inherited, stored

    found = {}
    for f in counts:
        if f.startswith("=") and len(f) < 5:  # shorter than a beginning
            p = (counts[f][1] + toxicity.PRIOR * base) / (sum(counts[f]) + toxicity.PRIOR)
            score = math.log(p / (1 - p)) - math.log(base / (1 - base))
            if abs(score) >= toxicity.TOLERANCE:
                found[f] = score
            continue
        _, score, stored = estimate(f)
        if stored:
            found[f] = score
    return found


def test_toxicity_equals_a_plain_version(spark):
    rows, labels = toxic_corpus(300)
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    want = plain_log_odds([r[1] for r in rows], [toxic for _, toxic in labels])
    assert set(model.log_odds) == set(want) and len(want) > 3
    assert all(abs(model.log_odds[f] - x) < 1e-9 for f, x in want.items())
    best = []
    for row in rows:
        tokens = [toxicity.EDGES.sub("", w) for w in row[1].lower().split()]
        own = [next((want[f] for f in ("=" + w, *(w[:n] for n in range(8, 3, -1) if len(w) >= n)) if f in want), 0.0) for w in tokens]
        best.append((best_segments([x + toxicity.DRIFT for x in own]), len(tokens)))
    # the law's parameters from the clean documents' best segments
    clean = sorted(max((s for s, _, _ in found), default=0.0) - math.log(n) for (found, n), (_, toxic) in zip(best, labels, strict=True) if not toxic)
    low, high = (clean[math.ceil(q * len(clean)) - 1] for q in (toxicity.LOW, toxicity.HIGH))
    gumbel = [-math.log(-math.log(q)) for q in (toxicity.LOW, toxicity.HIGH)]
    scale = max((high - low) / (gumbel[1] - gumbel[0]), 0.05)
    assert abs(model.scale - scale) < 1e-6 and abs(model.location - (low - gumbel[0] * scale)) < 1e-6
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for (found, n), row in zip(best, rows, strict=True):
        each = sorted((-math.log10(max(-math.expm1(-math.exp(-max(min((s - math.log(n) - model.location) / scale, 600), -6))), 1e-12)) for s, _, _ in found), reverse=True)
        evidence = sum(each[:1]) + sum(e for e in each[1:] if e > -math.log10(0.05))
        score = 1 / (1 + math.exp(-max(min(model.intercept + model.slope * evidence, 40), -40)))
        assert abs(got[row[0]]["score"] - score) < 1e-6


def test_toxicity_of_a_large_rare_vocabulary(spark):
    """Three hundred toxic words, each in few documents, with digits and signs within, beside two clean outliers."""
    rng = random.Random(9)
    rude = [f"{a}{rng.choice('0134')}{b}-{c}" for a in "bdfgk" for b in ("orx", "ulp", "izz", "agg", "emm", "oth") for c in "nrstvwxyzq"]
    rows, labels = [], []
    for i in range(1500):
        words = text_of(rng, rng.randrange(30, 150)).split()
        toxic = i % 5 == 1
        for _ in range(8 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude).upper() + rng.choice([",", "", "!"]))
        rows.append((i, " ".join(words), *[None] * 9))
        labels.append((i, int(toxic)))
    for i in (1500, 1501):
        rows.append((i, " ".join(rng.choices(rude, k=4000)), *[None] * 9))
        labels.append((i, 0))
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int").where(~held_out(0)))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    tested = [(scored[i] >= 0.5, toxic) for i, toxic in labels if i < 1500 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p for p, toxic in tested if toxic]) > 0.9
    assert np.mean([not p for p, toxic in tested if not toxic]) > 0.98


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = frame(spark, [*rows, *[(None, t, *[None] * 9) for t in (None, "", "nasty " * 5)]])
    given_labels = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, given_labels.where(~held_out(0)))
    scored = toxicity.score(docs, model).collect()
    truth = dict(labels)
    tested = [r for r in scored if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in tested]) > 0.97
    assert any(r["passages"] for r in tested)
    assert len({r["score"] for r in scored if r["doc_id"] is None}) == 2
    stays = toxicity.reject_toxic(docs, model)
    assert stays.dtypes == docs.dtypes and 300 < stays.count() < 340


def test_toxicity_without_labels(spark):
    docs = frame(spark, awkward_rows())
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert {round(r["score"], 6) for r in scored.collect()} == {0.0}


def test_language_model(spark):
    rows = awkward_rows()
    got = lm.score_texts(frame(spark, rows), ~held_out(1)).collect()
    assert len(got) == len(rows)
    in_training = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    count, pairs, texts = Counter(), Counter(), 0
    for r in rows:
        if in_training(r[0]):
            tokens = [*words_of(r[1]), None]
            count.update(tokens)
            pairs.update(zip(["<", *tokens], tokens, strict=False))
            texts += 1
    total, words = sum(count.values()), len(count)
    root = lambda w: (count[w] + 0.5) / (total + 0.5 * (words + 1))
    assert abs(sum(map(root, count)) + root("never seen") - 1) < 1e-9
    by_row = {}
    for r in rows:
        tokens = [*words_of(r[1]), None]
        sums = []
        for parts in lm.SMOOTHINGS:
            log = 0.0
            for h, w in zip(["<", *tokens], tokens, strict=False):
                c = texts if h == "<" else count[h]
                log += math.log10(sum(share * (pairs[h, w] + m * root(w)) / (c + m) for share, m in parts))
            sums.append(log)
        known = sum(count[w] > 0 for w in tokens)
        by_row.setdefault(r[0], []).append((len(tokens), known, sum(math.log10(root(w)) for w in tokens), sums))
    chosen = set()
    for r in got:
        match = [
            {i for i, s in enumerate(sums) if math.isclose(s, r["score"], rel_tol=1e-9)}
            for n, known, base, sums in by_row[r["doc_id"]]
            if (n, known) == (r["n_tokens"], r["n_known"]) and math.isclose(base, r["base_score"], rel_tol=1e-9)
        ]
        assert r["train_tokens"] == total and any(match)
        chosen = chosen & set.union(*match) if chosen else set.union(*match)
    assert len(chosen) >= 1  # one mixture explains all rows


def test_language_model_empty(spark):
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), ~held_out(1)).count() == 0
    only_held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm.score_texts(frame(spark, [(only_held_out, "a b", *[None] * 9)]), ~held_out(1)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["score"] <= 0


def secret_corpus(n=300):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(n):
        words = text_of(rng, 30).split()
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        number = str(rng.randrange(10**15, 10**16))
        words.insert(rng.randrange(1, 30), f'token = "{key}"' if i % 2 else number)
        rows.append((i, " ".join(words), *[None] * 9))
        truth[i] = (key, 1) if i % 2 else (number, 0)
    return rows, truth


def test_secrets(spark):
    rows, truth = secret_corpus()
    docs = frame(spark, [*rows, *awkward_rows()[:3], (None, None, *[None] * 9)])
    found = [r for r in secrets.scan(docs).collect() if r["doc_id"] is not None]
    got = {(r["doc_id"], r["candidate"]): r["is_secret"] for r in found}
    right = [got.get((i, c)) == bool(label) for i, (c, label) in truth.items()]
    assert np.mean(right) > 0.98
    reviewed = secrets.candidates(docs).where("doc_id < 150")
    labelled = secrets.weak_labels(reviewed)
    held = [r for r in secrets.scan(docs, labelled).collect() if r["doc_id"] is not None and r["doc_id"] >= 150]
    assert np.mean([r["is_secret"] == bool(truth[r["doc_id"]][1]) for r in held if r["candidate"] == truth[r["doc_id"]][0]]) > 0.98


def test_every_run_of_a_token(spark):
    key, other, name = "wJalrXUtnFEMI/K7MDENG/bPx", "0123456789abcdef0123", "aws_secret_access_key"
    texts = [
        f"say {name}={key}", f"postgresql://application_user:{key}@host", f'日本𝄞 {{"é𝄞":"{key}","api_key":"{other}","a":"{key}"}} end',
        f"{key}.{other}.{key[::-1]}", "//application_user:short.aaaaaaaaaaaaaaaa", ",".join(f"{i:020d}" for i in range(3000)),
    ]
    found = secrets.candidates(frame(spark, [(i, t, *[None] * 9) for i, t in enumerate(texts)])).collect()
    got = {(r["doc_id"], r["place"], r["offset"], r["candidate"]): r for r in found}
    want = {
        (i, place, m.start(), m.group())
        for i, t in enumerate(texts)
        for place, token in enumerate(t.split())
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", token)
        if len(m.group()) >= 20 or re.search("[0-9]", m.group())
    }
    assert set(got) == want and len(found) == len(want) and (2, 1, 7, key) in want
    assert got[0, 1, 22, key]["before"] == ["say", f"{name}="] and got[0, 1, 0, name]["after"][0] == "=wJalrXUtnFEMI"
    assert got[1, 0, 30, key]["before"][-1] == "application_user:" and got[1, 0, 30, key]["token"] == texts[1]
    assert any(r["before"][-1] == 'api_key":"' and r["candidate"] == other for r in found)
    assert max(len(r["token"]) for r in found) < 200


def test_secret_statistics_of_all_texts(spark):
    """Dictionary and letter pairs are the corpus's, whatever findings are reviewed or drawn."""
    rows, _ = secret_corpus(40)
    docs = frame(spark, [*rows, (900, "Wörter far-off from any finding, far_off", *[None] * 9), (901, None, *[None] * 9)])
    want = Counter(
        w
        for r in [*rows, (900, "Wörter far-off from any finding, far_off")]
        for w in re.findall(r"[^\W\d_]{3,}", re.sub(r"[A-Za-z0-9+/_-]{16,}", " ", r[1]).lower())
    )
    pairs = Counter()
    for w, n in want.items():
        for i in range(len(w) - 1):
            pairs[w[i : i + 2]] += n
    total = sum(pairs.values())
    labelled = secrets.weak_labels(secrets.candidates(docs))
    for reviewed, most in ((labelled.where("doc_id < 2"), 20_000), (labelled, 4)):
        model = secrets.train(reviewed, docs, most)
        assert {r["word"] for r in model.words.collect()} == set(want)
        got = {r["pair"]: r["log_p"] for r in model.pairs.collect()}
        assert set(got) == set(pairs) and all(math.isclose(p, math.log10(pairs[k] / total), abs_tol=1e-9) for k, p in got.items())


def test_secrets_without_findings(spark):
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    found = secrets.scan(frame(spark, [(1, "key 1234567890abcdef1234", *[None] * 9)])).collect()
    assert [(r["probability"], r["is_secret"]) for r in found] == [(None, True)]


def test_bpe_and_scores_on_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fingerprint.edited_pairs(empty).count() == 0
    assert toxicity.score(empty, toxicity.ToxicityModel()).count() == 0
    if os.path.exists(VOCABULARY):
        assert bpe.round_trip_digests(empty, bpe.read_vocabulary(VOCABULARY)).count() == 0
