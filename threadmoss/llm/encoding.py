"""Encoding of texts with a public byte-level BPE vocabulary by a backtracking encoder.

The longest token at each byte comes from an Aho-Corasick automaton over the vocabulary; a pair-compatibility test tells
whether two neighbouring tokens are what the merges would leave, and where they aren't, the encoder backs up to the next
shorter token.  Each byte position is given up at most once, so a piece of any length takes linear time and the ids are
exactly those of the merge rules.  Decoding looks ids up in an offset table over one byte string.

The vocabulary is read on the executors from a path parameter; texts are cut into pieces, and each distinct piece of a
task is encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the published pre-tokenisation pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pieces that a task remembers, and the longest piece that is worth it
REMEMBERED, WORTH = 400_000, 64


class Encoder:
    """Encodes and decodes with the ranks of one vocabulary file (base64 token, rank)."""

    def __init__(self, path: str = VOCABULARY):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.tokens = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
        self.ids = {t: i for i, t in self.tokens.items()}
        self.cut = regex.compile(PATTERN).findall
        self.finder = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.finder.add_word(t.decode("latin-1"), i)
        self.finder.make_automaton()
        self.length = {i: len(t) for i, t in self.tokens.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, tuple[int, ...]] = {}
        size = max(self.tokens) + 1
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(self.tokens.get(i, b"")) for i in range(size)], out=self.offsets[1:])
        self.bytes = b"".join(self.tokens.get(i, b"") for i in range(size))

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.halves:
            self.halves[token] = self._split(token)
        return self.halves[token]

    def _split(self, token: int) -> tuple[int, int] | None:
        """Replays the merges over the token's own bytes up to the last one."""
        text = self.tokens[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ids.get(parts[i] + parts[i + 1])) is not None and r < token]
            if not ranked:
                return None
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        No merge across their border may come before the merges that closed the border on either side.  Going back in time,
        the younger of the two border tokens is opened into its halves; the pair across the border must never form a token
        that is older than the one just opened.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b, limit = left, right, None
        good = True
        while True:
            joined = self.ids.get(self.tokens[a] + self.tokens[b])
            # across the border this merge would have come first; at equal rank the left one goes first
            if joined is not None and (limit is None or joined < limit):
                good = False
                break
            ha, hb = self.split(a), self.split(b)
            if ha is None and hb is None:
                break
            if hb is None or (ha is not None and a > b):
                limit, a = a, ha[1]
            else:
                limit, b = b + 1, hb[0]
        if len(self.compatible) < 4_000_000:
            self.compatible[left, right] = good
        return good

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 for a single byte."""
        got = self.shorter.get(token)
        if got is None:
            text = self.tokens[token]
            got = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.shorter[token] = got
        return got

    def encode_bytes(self, text: bytes) -> list[int]:
        whole = self.ids.get(text)
        if whole is not None and (len(text) == 1 or self.split(whole) is not None):
            return [whole]
        n = len(text)
        longest = [-1] * n
        for end, token in self.finder.iter(text.decode("latin-1")):
            longest[end - self.length[token] + 1] = token  # ends rise, so the longest comes last
        alive = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            while True:
                end = pos + self.length[token]
                if alive[end] and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    break
                token = self.next_shorter(token)
                if token < 0:  # nothing goes on from here: give the place up and take the token before it back
                    alive[pos] = 0
                    token = out.pop()
                    pos -= self.length[token]
                    token = self.next_shorter(token)
                    while token < 0:
                        alive[pos] = 0
                        token = out.pop()
                        pos -= self.length[token]
                        token = self.next_shorter(token)
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.memory.get(text)
        if got is None:
            got = tuple(self.encode_bytes(text.encode("utf-8", "surrogatepass")))
            if len(text) <= WORTH:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        out: list[int] = []
        if text:
            for p in self.cut(text):
                out += self.piece(p)
        return out

    def count(self, text: str | None) -> int:
        return sum(len(self.piece(p)) for p in self.cut(text)) if text else 0

    def decode(self, ids: list[int]) -> bytes:
        at = self.offsets
        return b"".join(self.bytes[at[i] : at[i + 1]] for i in ids)


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)


def encode_text(text: Column, path: str = VOCABULARY) -> Column:
    """array<int> of token ids; null and empty texts give an empty array."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for texts in batches:
            ids: list[int] = []
            ends = np.zeros(len(texts) + 1, dtype=np.int32)
            for k, t in enumerate(texts.to_pylist()):
                if t:
                    for p in e.cut(t):
                        ids.extend(e.piece(p))
                ends[k + 1] = len(ids)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))

    return run(text)


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text, 0 for null."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield texts.map(e.count).astype("int64")

    return run(text)


def decode_ids(ids: Column, path: str = VOCABULARY) -> Column:
    """The bytes that a list of ids stands for, null for null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for many in batches:
            yield many.map(lambda x: None if x is None else e.decode(x))

    return run(ids)


def encoded(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every document; repeated doc_ids stay repeated."""
    return documents.select("doc_id", encode_text(F.col("text"), path).alias("ids"))
