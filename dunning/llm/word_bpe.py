"""Token counts of a word-end BPE tokenizer by rank-synchronous merging.

A batch's distinct pre-tokens are held as one ragged array of symbols. In each
round every pre-token merges all places of its lowest-ranked pair at once (left
to right where they overlap); pre-tokens without a mergeable pair leave, and the
symbols they are left with are their tokens. A merge only makes pairs of higher
rank, so this gives the same symbols as merging one place at a time.

The file's own settings are used: NFC, white space, lower case, the split pattern,
byte-level symbols with a word-end mark on the last, and strings of special tokens,
each one token. Counts of pre-tokens are remembered (a bounded number per worker).

Nulls and edges: a null or empty text has no bytes and no tokens; ids may be null or
repeated; long texts are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dunning.llm.common import add_columns
from dunning.llm.hashing import Lookup

LIMIT = 2048
#: Counts remembered by a worker; bounds memory, not results.
REMEMBERED = 600_000
NEVER = np.iinfo(np.int64).max

# Code points that the split pattern's engine here takes for letters or digits
# and the tokenizer library, of an earlier Unicode version, does not.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizer file (JSON) with a word-end mark, as the library reads it."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in splits] != ["Split", "ByteLevel"] or not splits[0]["invert"] or splits[1]["use_regex"] or splits[1]["add_prefix_space"]:
            raise ValueError("not a tokenizer of this kind")
        # white space as the file's pattern engine has it, and a slower pattern for texts with newer letters
        pattern, newer = splits[0]["pattern"]["Regex"], "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.newer = regex.compile(f"[{newer}]")
        letters, digits = rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]"
        others = rf"[^\p{{White_Space}}{letters}{digits}]"
        self.exact = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", others).replace(r"[\p{L}]", letters).replace(r"[\p{N}]", digits))
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.marks = [t["content"][:2] for t in spec["added_tokens"]]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.first = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(vocab) + 1
        left, right = (np.array([vocab[p[i]] for p in pairs], np.uint64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = Lookup(left * np.uint64(self.size) + right + np.uint64(1), np.arange(len(pairs)), NEVER)

    def lengths(self, words: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbol, seq = self.first[raw], np.repeat(np.arange(len(data)), sizes)
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[raw[ends]]
        count = np.ones(len(data), np.int64)
        while len(symbol):
            same = np.r_[seq[1:] == seq[:-1], False]
            rank = np.full(len(symbol), NEVER)
            at = np.flatnonzero(same)
            rank[at] = self.rank[(symbol[at] * self.size + symbol[at + 1] + 1).astype(np.uint64)]
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbol)])
            done = best == NEVER
            count[seq[starts[done]]] = sizes[done]
            least = np.repeat(best, sizes)
            hit = (rank == least) & (least != NEVER)
            # of neighbouring places that overlap, every other one from the left
            run = np.flatnonzero(hit)
            head = np.r_[True, np.diff(run) > 1] if len(run) else np.zeros(0, bool)
            hit[run[(np.arange(len(run)) - np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))) % 2 == 1]] = False
            place = np.flatnonzero(hit)
            symbol[place] = self.made[rank[place]]
            keep = np.repeat(~done, sizes)
            keep[place + 1] = False
            symbol, seq = symbol[keep], seq[keep]
        return count

    def words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stand between them."""
        if self.special is None or not any(m in text for m in self.marks):
            return self._words(text), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self._words(p)], len(parts) - 1

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            # lower case letter by letter: no final form of sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.newer.search(text):
                return self.exact.findall(text.lower())
        return self.split.findall(text.lower())


class Counter:
    """Token counts of texts, with a memory of pre-tokens."""

    def __init__(self, bpe: WordBpe, room: int):
        self.bpe, self.half, self.known, self.old = bpe, max(1, room // 2), {}, {}

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > self.half:
            self.old, self.known = self.known, {}
        split = [self.bpe.words(t) if t else ([], 0) for t in texts]
        new = set().union(*(w for w, _ in split)).difference(self.known)
        self.known.update((w, self.old[w]) for w in new if w in self.old)
        fresh = [w for w in new if w not in self.old]
        self.known.update(zip(fresh, self.bpe.lengths(fresh).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, w)) + n for w, n in split]


@lru_cache(maxsize=2)
def _counter(file: bytes, room: int) -> Counter:
    """Kept by a Python worker from one task to the next."""
    return Counter(WordBpe(file), room)


def _kernel(shared, room: int):
    counter = _counter(shared.value, room)

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(counter.counts(texts.to_pylist()), pa.int64())]

    return run


def with_tokens(df: DataFrame, file: bytes, text: str = "text", out: str = "n_tokens", remembered: int = REMEMBERED) -> DataFrame:
    """``df`` and its texts' token counts under the tokenizer ``file`` (a few MB, broadcast)."""
    shared = df.sparkSession.sparkContext.broadcast(file)
    return add_columns(df, text, [T.StructField(out, T.LongType())], partial(_kernel, shared, remembered))
