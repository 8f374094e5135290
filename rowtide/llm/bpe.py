"""BPE encoding by backtracking over longest matches, decoding with an offset table.

An Aho-Corasick automaton finds the longest token at every place of a word.
The encoder takes longest tokens from the left, accepts a token after another
only where the pair is compatible (the merges would have left the border
between the two alone), else takes the next shorter token or steps back; every
place is given up at most once, so the time is linear in the word. The result
is exactly that of applying the merges in order. Decoding copies the slices
of one byte string that an offset table names.

Texts are handled in Arrow batches, one word at a time; a worker keeps the
encodings of frequent words in a table of bounded size. The vocabulary file is
read by the driver and shipped with the job.

Defined results: a null text counts as empty and has no tokens. The strings of
special tokens are encoded as these tokens. Rows are independent: repeated
rows repeat, other columns are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.common import id_and_text, prepare

CACHED_PIECES, CACHED_WORDS, CACHED_PAIRS = 250_000, 400_000, 500_000
DECODED_AT_ONCE = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return letters


class Vocabulary:
    """Tables of one tokenizer file: byte-level BPE, with or without a word-end suffix."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.nfc = '"NFC"' in json.dumps(spec.get("normalizer"))
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        pattern = _pattern_of(spec["pre_tokenizer"])
        self.word_pattern, self.careful_pattern = regex.compile(pattern), regex.compile(_without_newer_letters(pattern))
        # A token's text with its suffix as the one letter NUL, which stands for no byte.
        own = {i: (t[: -len(self.suffix)] + "\0" if self.suffix and t.endswith(self.suffix) and t != self.suffix else t) for t, i in ids.items()}
        self.text = {i: t for i, t in own.items() if i not in self.special.values()}
        self.id_of = {t: i for i, t in self.text.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # rank 0 for what no merge makes; a merge's rank orders it
        self.rank = dict.fromkeys(self.text, 0)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges, 1):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.pair.setdefault((left, right), whole)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), r
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            # a suffix cannot be split off a letter: nothing starts or ends between the two
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.id_bytes = {i: i.to_bytes(4, "little") for i in self.text}
        self.length = {i: len(t) for i, t in self.text.items()}
        self.stable: dict[int, bool] = {}
        self._offset_table(ids)

    def _offset_table(self, ids: dict[str, int]) -> None:
        # Decoding without a decoder joins the token strings by blanks; they are stored as UTF-8 with that blank in front.
        size = max([*ids.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for t, i in [*ids.items(), *self.special.items()]:
            strings[i] = b" " + t.encode()
        self.blob = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings])))

    # --- encoding

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging ``left`` and ``right`` written side by side leaves both as they are.

        Walks down the border of both: as long as a merge over the border
        would have come first, the pair is not stable.
        """
        pair, parts, rank = self.pair, self.parts, self.rank
        # the merge over the border must come no earlier than the one that hid it on either side
        limit_left = limit_right = float("inf")
        while True:
            over = pair.get((left, right))
            if over is not None:
                r = rank[over]
                # left neighbours merge first on equal ranks
                if r < limit_left and r <= limit_right:
                    return False
            lr, rr = rank[left], rank[right]
            if lr == 0 and rr == 0:
                return True
            if lr >= rr:
                limit_left, left = min(limit_left, lr), parts[left][1]
            else:
                limit_right, right = min(limit_right, rr), parts[right][0]

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        text = self.text[token]
        return next((self.id_of[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id_of), None)

    def fits(self, left: int, right: int) -> bool:
        """``compatible``, remembered for at most ``CACHED_PAIRS`` pairs."""
        key = left << 32 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= CACHED_PAIRS:
                self.stable.clear()
            known = self.stable[key] = self.compatible(left, right)
        return known

    def encode_letters(self, word: str) -> list[int]:
        """Tokens of a word in byte letters, its suffix included as NUL."""
        longest: list[int | None] = [None] * len(word)
        for end, (n, token) in self.automaton.iter(word):
            longest[end - n + 1] = token
        open_at = [True] * (len(word) + 1)
        tokens: list[int] = []
        at, token, length, fits = 0, longest[0], self.length, self.fits
        while at < len(word):
            if token is None:
                # nothing fits here: give the place up and shorten the token before
                open_at[at] = False
                token = tokens.pop()
                at -= length[token]
                token = self.shorter(token)
                continue
            end = at + length[token]
            if open_at[end] and (not tokens or fits(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = longest[at] if at < len(word) else None
            else:
                token = self.shorter(token)
        return tokens

    def encode_word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.letters)
        if self.suffix:
            word += "\0"
        id_bytes = self.id_bytes
        return b"".join([id_bytes[i] for i in self.encode_letters(word)])

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # letter by letter: the final sigma is no exception
        return text.replace("Σ", "σ").lower() if self.lower else text

    def encoder(self) -> Encoder:
        return Encoder(self)

    # --- decoding

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """Pieces of the decoded text in UTF-8."""
        for at in range(0, len(ids), DECODED_AT_ONCE):
            part = ids[at : at + DECODED_AT_ONCE].astype(np.int64)
            begins = self.offsets[part]
            lengths = self.offsets[part + 1] - begins
            ends = np.cumsum(lengths)
            source = np.arange(ends[-1]) + np.repeat(begins - (ends - lengths), lengths)
            piece = self.blob[source].tobytes()
            yield piece if at else piece[1:]


class Encoder:
    """Encodes texts; keeps the ids of a bounded number of words, and of the pieces between blanks they stand in."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pieces, self.words = vocabulary, {}, {}

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.vocabulary.encode_word(word)
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            if len(word) <= 32:
                self.words[word] = got
        return got

    def _piece(self, piece: str) -> bytes:
        v = self.vocabulary
        pattern = v.word_pattern if piece.isascii() or newer_letters().isdisjoint(piece) else v.careful_pattern
        got = b"".join([self._word(w) for w in pattern.findall(v.normal(piece))])
        if len(self.pieces) >= CACHED_PIECES:
            self.pieces.clear()
        if len(piece) <= 32:
            self.pieces[piece] = got
        return got

    def _plain(self, text: str) -> list[bytes]:
        # str.split also parts at U+001C to U+001F, which are not white space to the tokenizer
        pieces = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else regex.split(r"[\s--[\x1c-\x1f]]+", text, flags=regex.V1)
        known, piece = self.pieces.get, self._piece
        return [known(p) or piece(p) for p in pieces if p]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        v = self.vocabulary
        if not v.special or "<" not in text and not any(s in text for s in v.special):
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in v.special_pattern.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(np.array([v.special[m.group()]], dtype="<u4").tobytes())
            at = m.end()
        return b"".join([*out, *self._plain(text[at:])])


def _pattern_of(pre_tokenizer: dict) -> str:
    parts = pre_tokenizer.get("pretokenizers", [pre_tokenizer])
    split = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"]
    if len(split) != 1 or not any(p["type"] == "ByteLevel" and not p["add_prefix_space"] for p in parts):
        raise ValueError("a pattern split followed by byte letters is expected")
    return split[0]


@functools.lru_cache(maxsize=1)
def newer_letters() -> frozenset[str]:
    """Letters of the pattern library's Unicode version that this Python's does not have yet."""
    letters = regex.findall(r"\p{L}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    return frozenset(c for c in letters if unicodedata.category(c) == "Cn")


def _without_newer_letters(pattern: str) -> str:
    listed = "".join(map(regex.escape, sorted(newer_letters()))) or r"\0"
    pattern = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{listed}]]")
    return "(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{listed}]]")


@functools.lru_cache(maxsize=4)
def _encoder(content: str) -> Encoder:
    return Vocabulary(content).encoder()


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_column(docs: DataFrame, content: str, text: Column) -> Column:
    """Array of token ids of a text column."""
    shipped = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary file, whatever the table's size

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shipped.value)
        for texts in parts:
            yield pd.Series([np.frombuffer(encoder.encode(t or ""), dtype="<u4").astype(np.int32) for t in texts])

    return ids(text)


def decode_column(docs: DataFrame, content: str, ids: Column) -> Column:
    """Text of an array of token ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _encoder(shipped.value).vocabulary
        for lists in parts:
            yield pd.Series([b"".join(vocabulary.decode(np.asarray(x, dtype=np.int64))).decode("utf-8", "replace") for x in lists])

    return text(ids)


def round_trip_digests(docs: DataFrame, content: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``; ids are decoded where they were made."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shipped.value)
        for texts in parts:
            rows = []
            for t in texts:
                ids = encoder.encode(t)
                decoded = hashlib.sha256()
                for piece in encoder.vocabulary.decode(np.frombuffer(ids, dtype="<u4")):
                    decoded.update(piece)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")
