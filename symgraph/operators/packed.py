"""Several values packed in one text field: one row per value, with its position.

Method: a value's *delimiter skeleton* masks every run of ordinary characters by one letter
and keeps the characters that can matter (delimiters, blanks, quotes, brackets, ``@`` and
backslash). Values have few distinct skeletons, so the splitting rule (token spans and how to
undo escapes) is resolved once per distinct skeleton and written; values that plainly hold no
item (``[]`` is the most frequent of all) have none. The rules' size is then known: up to
``BROADCAST`` bytes they are broadcast, and no value is shuffled; beyond that they are joined
with the most frequent skeletons spread over ``SALTS`` parts. The extraction itself is
positional (slices of the value's token array) and stays in the JVM.

Defined results: a null, empty or blank value and a value of empty pieces give no row; an
unclosed quote or bracket is an ordinary character; equal items keep their own positions;
exact duplicate rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Characters that the skeleton keeps.
SPECIAL = ",;|\n\r\t \"'()[]{}@\\"
_CLASS = r",;|\n\r\t \"'()\[\]{}@\\"
_TOKEN = rf"[^{_CLASS}]+|[ \t]+|[{_CLASS}]"
_RULE = "start array<int>, len array<int>, how array<string>"
_PAIR = {"(": ")", "[": "]", "{": "}"}
_SPLIT = ",;|\n\r"
#: Blanks and delimiters alone, in a list's brackets or not: no item.
_NOTHING = r"^(?:[\s,;|]*|\s*\[[\s,;|]*\]\s*)$"
#: Bytes of rules (as written) up to which they are broadcast.
BROADCAST = 8 << 20
#: Parts that a skeleton's values are spread over where the rules are not broadcast.
SALTS = 16


def skeleton(col: Column) -> Column:
    masked = F.regexp_replace(col, rf"[^{_CLASS}]+", "a")
    return F.regexp_replace(masked, r"[ \t]+", " ")


def _close(s: str, i: int, end: int) -> int:
    """Where the quote or bracket at ``i`` ends, or -1 if it stays open before ``end``."""
    c = s[i]
    if c in "\"'":
        j = i + 1
        while j < end:
            if s[j] == "\\":
                j += 2
                continue
            if s[j] == c:
                if j + 1 < end and s[j + 1] == c:  # a doubled quote is an escaped one
                    j += 2
                    continue
                return j
            j += 1
        return -1
    stack = [_PAIR[c]]
    j = i + 1
    while j < end:
        d = s[j]
        if d == "\\":
            j += 2
            continue
        if d in "\"'":
            k = _close(s, j, end)
            j = k + 1 if k >= 0 else j + 1
            continue
        if d in _PAIR:
            stack.append(_PAIR[d])
        elif d == stack[-1]:
            stack.pop()
            if not stack:
                return j
        j += 1
    return -1


def rule(s: str, at_sign: bool = True) -> list[tuple[int, int, str]]:
    """The spans (start from 1, length, escape style) of the items of skeleton ``s``."""
    lo, hi = 0, len(s)

    def strip(a: int, b: int) -> tuple[int, int]:
        while a < b and s[a] in " \t\r\n":
            a += 1
        while b > a and s[b - 1] in " \t\r\n":
            b -= 1
        return a, b

    lo, hi = strip(lo, hi)
    if hi - lo >= 2 and s[lo] == "[" and _close(s, lo, hi) == hi - 1:
        lo, hi = lo + 1, hi - 1
    pieces, start, i = [], lo, lo
    while i < hi:
        c = s[i]
        if c == "\\":
            i += 2
        elif c in "\"'([{":
            k = _close(s, i, hi)
            i = k + 1 if k >= 0 else i + 1
        elif c in _SPLIT:
            pieces.append((start, i))
            start = i = i + 1
        elif c == " " and at_sign and i + 1 < hi and s[i + 1] == "@":
            pieces.append((start, i))
            start = i = i + 1
        else:
            i += 1
    pieces.append((start, hi))
    out = []
    for a, b in pieces:
        a, b = strip(a, b)
        if at_sign and a < b and s[a] == "@":
            a, b = strip(a + 1, b)
        how = "plain"
        if b - a >= 2 and s[a] in "\"'" and _close(s, a, b) == b - 1:
            quote, a, b = s[a], a + 1, b - 1
            inner = s[a:b]
            how = "escaped" if "\\" in inner else "doubled" + quote if quote * 2 in inner else "plain"
            a, b = strip(a, b)
            if at_sign and a < b and s[a] == "@":
                a, b = strip(a + 1, b)
        if a < b:
            out.append((a + 1, b - a, how))
    return out


def _resolve(at_sign: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rules = [rule(s, at_sign) for s in pdf["skeleton"]]
            yield pd.DataFrame(
                {
                    "skeleton": pdf["skeleton"],
                    "start": [[r[0] for r in rs] for rs in rules],
                    "len": [[r[1] for r in rs] for rs in rules],
                    "how": [[r[2] for r in rs] for rs in rules],
                }
            )

    return run


def _undo(text: Column, how: Column) -> Column:
    """Undo the escapes of a quoted item (JSON's, and the quote and hex escapes of reprs)."""
    t = F.regexp_replace(text, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    t = F.regexp_replace(t, r"\\'", "'")
    t = F.regexp_replace(t, r'(?<!\\)"', r"\\\"")
    parsed = F.from_json(F.concat(F.lit('["'), t, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})
    plain = F.regexp_replace(text, r"\\(.)", "$1")
    return (
        F.when(how == "escaped", F.coalesce(F.get(parsed, F.lit(0)), plain))
        .when(how == 'doubled"', F.replace(text, F.lit('""'), F.lit('"')))
        .when(how == "doubled'", F.replace(text, F.lit("''"), F.lit("'")))
        .otherwise(text)
    )


def packed_items(df: DataFrame, key: str, value: str, at_sign: bool = False, source: DataFrame | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """``(key, items)``: the array of the items packed in ``value``; rows without an item are left out.

    ``df``'s other columns stay. ``source``: a table with all of ``df``'s values, more do no harm,
    from which to find the skeletons where computing ``df`` is dear.
    """
    filled = lambda t: t.where(F.col(value).isNotNull() & ~F.col(value).rlike(_NOTHING))
    others = [c for c in df.columns if c not in (key, value)]
    rows = filled(df).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.struct(*others).alias("_others") if others else F.lit(0).alias("_others"), skeleton(F.col(value)).alias("skeleton"))
    scratch = Scratch(df.sparkSession, "rules")
    rules = filled(df if source is None else source).select(skeleton(F.col(value)).alias("skeleton")).distinct().mapInPandas(_resolve(at_sign), f"skeleton string, {_RULE}").where(F.size("start") > 0)
    rules = scratch.keep(scratch.write(rules))
    if scratch.size(rules) <= broadcast:
        both = rows.join(F.broadcast(rules), "skeleton")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        both = rows.withColumn("_s", F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int")).join(rules.withColumn("_s", salts), ["skeleton", "_s"])
    tokens = F.regexp_extract_all(F.col("_v"), F.lit(f"({_TOKEN})"), F.lit(1))
    item = lambda r: _undo(F.array_join(F.slice("_t", r["start"], r["len"]), ""), r["how"])
    return both.withColumn("_t", tokens).select(
        F.col("_k").alias(key), *[F.col("_others")[c].alias(c) for c in others], F.transform(F.arrays_zip("start", "len", "how"), item).alias("items")
    )


def split_packed(df: DataFrame, key: str, value: str, at_sign: bool = False, source: DataFrame | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """``(key, pos, item)`` for every item packed in ``value``.

    ``at_sign``: a leading ``@`` belongs to the notation, and a blank before one separates.
    """
    items = packed_items(df.select(key, value), key, value, at_sign, source, broadcast)
    return items.select(key, F.posexplode("items").alias("pos", "item")).withColumn("pos", F.col("pos") + 1)
