"""Hand-made documents with every awkward row, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, keep string, digest string, TEXT string, component_id string, __row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(rng: random.Random, words: int) -> str:
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(words))


def awkward_rows(seed: int = 1) -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(seed)
    base = text_of(rng, 60)
    words = base.split()
    near = [" ".join(words[:k] + ["CHANGED"] + words[k + 1 :]) for k in (5, 20, 40, 59)]
    texts = [
        None, "", " \t\n ", "one", "One", "two words", "éa ß Σ\n日本", base, base, *near, base.upper(),
        text_of(rng, 20_000), "x" * 30_000, "a\nb\nc\nd\n" * 30, *[text_of(rng, rng.randrange(1, 80)) for _ in range(25)],
    ]
    rows = [
        (i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t),
         "r", None, "d", "T", "c", "w")
        for i, t in enumerate(texts)
    ]
    repeated = rows[7]
    no_id = [(None, t, None, None, None, None, None, None, None, None, None) for t in (None, "no id", base)]
    return [*rows, repeated, repeated, *no_id]


def frame(spark, rows):
    from rowtide.llm.common import prepare

    return prepare(spark).createDataFrame(rows, SCHEMA).repartition(3)


def words_of(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def shingles(text: str | None, k: int) -> set[tuple]:
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(texts: dict, k: int, percent: int = 80) -> dict:
    """Smallest id reachable over links, by comparing every pair."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in texts}
