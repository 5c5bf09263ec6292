"""Encoding a whole corpus with a public byte-level BPE tokenizer.

Method: a monoid of encoded pieces. Every text is halved down to leaves of at most ``LEAF``
characters, the leaves are encoded, and neighbours join up the tree. A join re-encodes a window
around the boundary and keeps all tokens outside of it, which provably are those of the joined
text: the tokenizer first cuts a text into words by a pattern that scans from left to right, and
merges bytes within words only. Some places end a word whatever stands before or behind them

* between a character other than a blank and a blank,
* between a letter, a digit and another character, but for behind an apostrophe,

because no alternative of the pattern spans them, none looks back, and only blanks look ahead, so
that neither the words before such a place nor those behind it depend on the other side. The
window runs from the last such place on the left to the first one on the right; it is looked for
in stretches of growing length, at worst to the outer end of the neighbour. Tokens are cut at the places by
counting bytes from the boundary, so a join costs what its window costs. Decoding concatenates the
bytes of the ids up the tree.

Defined results: an empty and a null text have the empty list; strings that look like special
tokens are ordinary text; any other text decodes to itself exactly.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf: a text beyond is halved.
LEAF = 128
#: Characters in which a place is looked for first.
NEAR = 24

# Where every scan ends a word; the character before and the one behind decide.
_PLACE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public tokenizer's ranks are, by the installed package (a parameter elsewhere)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """``path``: the tokenizer's ranks, a token in base 64 and its id per line."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(w): int(n) for w, n in map(bytes.split, f)}
        self.leaf = leaf
        self.words = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: The bytes of each id, and how many they are.
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, n in ranks.items():
            self.vocab[n] = word
        self.sizes = [len(w) for w in self.vocab]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocab[i] for i in ids).decode()

    @staticmethod
    def _last(text: str, lo: int, hi: int) -> int:
        """The last place within ``text[lo:hi]``, or ``lo``."""
        near = NEAR
        while True:
            start = max(lo, hi - near)
            at = lo
            for m in _PLACE.finditer(text, start, hi):
                if lo < m.start() < hi:
                    at = m.start()
            if at > lo or start == lo:
                return at
            near *= 4

    @staticmethod
    def _first(text: str, lo: int, hi: int) -> int:
        """The first place within ``text[lo:hi]``, or ``hi``."""
        m = _PLACE.search(text, lo + 1, hi)
        return m.start() if m else hi

    def _join(self, text: str, lo: int, mid: int, hi: int, a: list[int], b: list[int]) -> list[int]:
        """The ids of ``text[lo:hi]`` from those of its halves, by re-encoding a window around ``mid``."""
        x, y = self._last(text, lo, mid), self._first(text, mid, hi)
        sizes = self.sizes
        left, n = len(text[x:mid].encode()), len(a)
        while left > 0:
            n -= 1
            left -= sizes[a[n]]
        right, k = len(text[mid:y].encode()), 0
        while right > 0:
            right -= sizes[b[k]]
            k += 1
        return a[:n] + self.words.encode_ordinary(text[x:y]) + b[k:]

    def _reduce(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.words.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._reduce(text, lo, mid), self._reduce(text, mid, hi))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, all by the reduction."""
        return [self._reduce(t, 0, len(t)) if t else [] for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """One per Python worker."""
    return Encoder(path, leaf)


def encode(df: DataFrame, key: str, text: str, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``(key, ids)`` for every row of ``df``; no shuffle. Null and empty texts have no ids."""
    path = path or tokenizer_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for batch in batches:
            ids = pa.array(e.encode(batch.column(1).to_pylist()), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["_k", "ids"])

    narrow = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return narrow.mapInArrow(run, f"_k {kind}, ids array<int>").withColumnRenamed("_k", key)


def token_counts(df: DataFrame, columns: list[str], text: str, path: str | None = None) -> DataFrame:
    """``columns`` and ``n_tokens`` (0 for a null or empty text); the ids do not leave the worker."""
    path = path or tokenizer_path()
    narrow = df.select(*columns, F.col(text).alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.drop("_t").schema) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for pdf in batches:
            counts = [len(x) for x in e.encode([t if isinstance(t, str) else None for t in pdf["_t"]])]
            yield pdf.drop(columns="_t").assign(n_tokens=counts)

    return narrow.mapInPandas(run, schema)
