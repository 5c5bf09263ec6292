"""Tokens of many lines at once, and the contexts in which they stand, as 64-bit keys.

A token is a word, a run of Latin letters and digits with a digit in it (all of these are one
token), or a single sign. Its contexts are, from the narrowest to the widest: after the two tokens
before it, in the frame of its line (with its first token; near the line's start only), after the
one before it, alone. Whether a blank stands before the token belongs to each. Beginnings of a word,
after the token before it and alone, have keys too, so that a fragment can be looked up.

All of it is arithmetic on whole arrays: a beginning's hash is a difference of running sums of
character codes times powers of an odd number, modulo 2 to the 64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places from a line's start up to which the pair of its first and its current token is a context.
FRAME = 7
TERMINATORS = ".!?。！？"
_QUOTES = "\"'`)]}»”’"
#: Characters that are worked on at once.
CHUNK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MUL = _U(0xFF51AFD7ED558CCD)
_NONE, _DIGIT, _LATIN, _LETTER, _SIGN = range(5)
_RUN, _WORD, _SINGLE = 1, 2, 3
_SPACE, _NEWLINE = 8, 16
_OTHER = 32  # a letter of a word that isn't alphabetic

_table = np.full(0x110000, 255, np.uint8)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _kinds(codes: np.ndarray) -> np.ndarray:
    """A kind per character; characters are looked at once per process."""
    kinds = _table[codes]
    if (kinds == 255).any():
        for c in np.unique(codes[kinds == 255]).tolist():
            ch = chr(c)
            if ch == "\n":
                k = _NONE | _NEWLINE
            elif ch.isspace():
                k = _NONE | _SPACE
            elif ch.isdecimal():
                k = _DIGIT
            elif ch.isascii() and ch.isalpha():
                k = _LATIN
            elif ch.isalnum():
                k = _LETTER if ch.isalpha() else _LETTER | _OTHER
            else:
                k = _SIGN
            _table[c] = k
        kinds = _table[codes]
    return kinds


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * CHUNK), base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def _mix(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    # hashes of single characters are small: the number of a context is spread over all bits
    x = (b ^ (_U(a * _BASE % (1 << 64)) if isinstance(a, int) else a)) * _MUL
    x ^= x >> _U(32)
    x *= _MUL
    x ^= x >> _U(29)
    return x


_LINE = _U(0x51ED270B9A3C1F07)


@dataclass
class Tokens:
    """Arrays with an entry per token; ``start`` and ``stop`` are places in the text."""

    start: np.ndarray
    stop: np.ndarray
    gap: np.ndarray  # a blank before it
    place: np.ndarray  # in its line, from 0
    last: np.ndarray  # of its line
    alpha: np.ndarray  # a word of letters
    ends: np.ndarray  # a terminator
    quote: np.ndarray
    hash: np.ndarray
    one: np.ndarray  # hash of the token before it
    sums: np.ndarray
    keys: dict[str, np.ndarray]  # k3, k4, k2, k1
    framed: np.ndarray  # has a k4

    def beginnings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all strict beginnings of the chosen words: after a token, and alone."""
        size = (self.stop - self.start)[chosen] - 1
        chosen, size = chosen[size > 0], size[size > 0]
        which = np.repeat(chosen, size)
        at = self.start[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        return self._begun(which, at + 1)

    def whole(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of words as beginnings of longer ones."""
        return self._begun(chosen, self.stop[chosen])

    def _begun(self, which: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inverse = _tables(len(self.sums))[1]
        start = self.start[which]
        part = (self.sums[stop] - self.sums[start]) * inverse[start]
        gap = self.gap.astype(_U)
        return _mix(_mix(_mix(106, self.one), gap)[which], part), _mix(_mix(105, gap)[which], part)


def tokenise(text: str) -> Tokens:
    """The tokens of the lines of ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds(codes)
    group = kinds & 7
    n = len(codes)
    power, inverse = _tables(n + 1)
    # stretches of one group; Latin letters join digits beside them, unless another letter is before
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    g = group[begin]
    before = np.concatenate(([0], g[:-1])) if n else g
    behind = np.concatenate((g[1:], [0])) if n else g
    run = (g == _DIGIT) | ((g == _LATIN) & ((before == _DIGIT) | ((before != _LETTER) & (behind == _DIGIT))))
    label = np.where(run, _RUN, np.where((g == _LATIN) | (g == _LETTER), _WORD, np.where(g == _SIGN, _SINGLE, 0))).astype(np.uint8)
    label = np.repeat(label, np.diff(np.concatenate((begin, [n]))))
    left, right = np.concatenate(([0], label[:-1])) if n else label, np.concatenate((label[1:], [0])) if n else label
    start = np.flatnonzero((label == _SINGLE) | ((label > 0) & (label != left)))
    stop = np.flatnonzero((label == _SINGLE) | ((label > 0) & (label != right))) + 1
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(codes.astype(_U) * power[:n], dtype=_U)))
    m = len(start)
    at = np.arange(m)
    line = np.cumsum((kinds & _NEWLINE) > 0)[start] if m else at
    first = np.concatenate(([True], line[1:] != line[:-1])) if m else at.astype(bool)
    last = np.concatenate((first[1:], [True])) if m else first
    head = np.maximum.accumulate(np.where(first, at, 0)) if m else at
    place = at - head
    gap = (start > 0) & ((kinds[start - 1] & _SPACE) > 0) if m else first
    odd = np.concatenate(([0], np.cumsum(((kinds & _OTHER) > 0) | (group == _DIGIT))))
    alpha = (label[start] == _WORD) & (odd[stop] == odd[start])
    single = label[start] == _SINGLE
    char = codes[start]
    ends = single & np.isin(char, [ord(c) for c in TERMINATORS])
    quote = single & np.isin(char, [ord(c) for c in _QUOTES])
    h = np.where(label[start] == _RUN, _U(ord("0")), (sums[stop] - sums[start]) * inverse[start])
    one = np.where(place >= 1, np.roll(h, 1), _LINE)
    two = np.where(place >= 2, np.roll(h, 2), _LINE)
    w = _mix(_mix(100, gap.astype(_U)), h)
    pair = _mix(_mix(102, one), w)
    keys = {"k3": _mix(_mix(103, two), pair), "k4": _mix(_mix(104, h[head]), w), "k2": pair, "k1": _mix(101, w)}
    return Tokens(start, stop, gap, place, last, alpha, ends, quote, h, one, sums, keys, (place >= 2) & (place < FRAME))


class Filter:
    """A set of keys as bits of their low ends: what is in it passes, few others do."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, np.uint8)
        self.mask = _U(8 * len(bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        low = keys & self.mask
        return keys[self.where(low)]

    def where(self, low: np.ndarray) -> np.ndarray:
        return ((self.bits[(low >> _U(3)).astype(np.int64)] >> (low & _U(7)).astype(np.uint8)) & 1).astype(bool)


def _observed(text: str, finals: list[int], wanted: Filter) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    t = tokenise(text)
    if not len(t.start):
        return []
    # the end of a text isn't counted: a cut would look like an end
    final = np.zeros(len(t.start), bool)
    final[np.searchsorted(t.start, finals) - 1] = True
    # behind a terminator only what follows without a blank goes on
    opens = np.concatenate(((t.gap | t.quote)[1:], [False]))
    end = np.where(t.last, ~final, t.ends & opens)
    seen = ~(t.last & final)
    out = []
    for name, keys in t.keys.items():
        which = seen & t.framed if name == "k4" else seen
        which = np.flatnonzero(which)[wanted.where(keys[which] & wanted.mask)]
        out.append((keys[which], end[which], np.zeros(len(which), bool)))
    for keys in t.beginnings(np.flatnonzero(seen & t.alpha)):
        keys = wanted(keys)
        no = np.zeros(len(keys), bool)
        out.append((keys, no, ~no))
    return out


def observe(bodies: list[str], wanted: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, on, end, begun)`` of the wanted keys in texts (with plain line ends).

    ``on``: how often a context goes on in its line; ``end``: how often a line, and not the text,
    or a sentence ends with it; ``begun``: how often a longer word begins so. Contexts don't reach
    over lines, so long texts are taken in stretches of lines.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    chunk: list[str] = []
    finals: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if chunk:
            found.extend(_observed("\n".join(chunk), finals, wanted))
            chunk.clear()
            finals.clear()
            size = 0

    for text in bodies:
        start = 0
        while start < len(text):
            stop = len(text)
            if stop - start > CHUNK:
                cut = text.rfind("\n", start + 1, start + CHUNK)
                cut = cut if cut > start else text.find("\n", start + CHUNK)
                stop = cut if cut > start else stop
            chunk.append(text[start:stop])
            size += stop - start + 1
            if stop == len(text):
                finals.append(size - 1)
            if size > CHUNK:
                flush()
            start = stop + 1
    flush()
    if not found:
        return np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
    keys, end, begun = (np.concatenate(x) for x in zip(*found))
    order, inverse = np.unique(keys, return_inverse=True)
    count = lambda which: np.bincount(inverse[which], minlength=len(order))
    return order, count(~end & ~begun), count(end), count(begun)
