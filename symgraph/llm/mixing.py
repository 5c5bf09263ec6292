"""Mixing sources to target shares of the total size, with capped repeats.

Method: budget fitting over exact lengths. Every document has its length in tokens. A source's
budget is its share of the total; whole passes over the source are taken as long as they fit
(never more than its cap of repeats allows), and the rest is a bounded subset-sum problem over
the histogram of lengths: first the same fraction of every length is taken, then lengths are
taken greedily from the longest down until less than ``window`` tokens (or twice the longest
document) are missing, then a bounded knapsack over the lengths up to the rest finds the best
addition. Where that misses the budget, the best exchange of taken documents for others follows;
it ends with a fill that no other choice of documents exceeds, whatever the size of the source.
Documents are then chosen by length count: of each length the first so many in the order of a
seeded hash.

The histogram of one source is one group of at most as many rows as there are distinct lengths
(fewer than the square root of twice its tokens); documents themselves never meet in one task:
ranks within a length are taken in 256 slices of the hash, with the slices' counts as offsets.

Defined results: documents without a token (null, empty) are never chosen; a source without
documents reaches nothing; exact duplicate rows count once; sources outside the targets take no
part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Tokens that the knapsack after the greedy pass covers at least.
WINDOW = 4096
_SLICES = 256
#: Bit sets that each level of the way back through a knapsack holds.
_BRANCH = 8
#: Divisors below this, and those that lengths share with so many of the most frequent ones, are
#: tried for remainders that no choice of documents has.
_MODULI = 64
_FREQUENT = 8
#: Target sources up to which they are a predicate.
_NAMED = 1000


def _parts(lengths: list[int], counts: list[int], most: int) -> list[tuple[int, int]]:
    """``(length, copies)`` by binary splitting, of each length as many as ``most`` tokens hold."""
    parts: list[tuple[int, int]] = []
    for n, c in zip(lengths, counts):
        c = min(c, most // n) if n > 0 else 0
        k = 1
        while c > 0:
            k = min(k, c)
            parts.append((n, k))
            c -= k
            k *= 2
    return parts


def _sums(parts: list[tuple[int, int]], most: int, reach: int = 1) -> int:
    """The sums up to ``most`` that ``parts`` on top of ``reach`` make, as a bit set."""
    limit = (1 << (most + 1)) - 1
    reach &= limit
    for n, k in parts:
        reach |= (reach << (n * k)) & limit
    return reach


def _back(parts: list[tuple[int, int]], before: int, left: int, taken: dict[int, int]) -> int:
    """Enter into ``taken`` which of ``parts`` make ``left`` on top of a sum of ``before``: that sum.

    A part is used only where those ahead of it don't make the sum. Bit sets between stretches are
    built again for each level of stretches, so that few are held at a time.
    """
    if len(parts) == 1:
        ((n, k),) = parts
        if not before >> left & 1:
            left -= n * k
            taken[n] = taken.get(n, 0) + k
        return left
    step = -(-len(parts) // _BRANCH)
    stretches = [parts[i : i + step] for i in range(0, len(parts), step)]
    kept = [before]
    for stretch in stretches[:-1]:
        kept.append(_sums(stretch, left, kept[-1]))
    while stretches:
        left = _back(stretches.pop(), kept.pop(), left, taken)
    return left


def fill(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take so that the sum is the largest that fits ``budget``.

    Bounded knapsack by binary splitting over a bit set of reachable sums; ``O(budget * log)``
    for each length, lengths above the budget aside.
    """
    parts = _parts(lengths, counts, budget)
    limit = (1 << (budget + 1)) - 1
    reach = 1
    for i, (n, k) in enumerate(parts):
        reach |= (reach << (n * k)) & limit
        if reach >> budget & 1:
            parts = parts[: i + 1]
            break
    taken: dict[int, int] = {}
    if parts:
        _back(parts, 1, reach.bit_length() - 1, taken)
    return taken


def _gain(removed: int, added: int, most: int) -> int:
    """By how much a sum of ``added`` exceeds one of ``removed``: the largest of 0 to ``most``."""
    low = 0
    while low < most:
        mid = (low + most + 1) // 2
        near, width = removed << mid, 1  # becomes the sums that a gain of mid to most reaches
        while width <= most - mid:
            step = min(width, most - mid + 1 - width)
            near |= near << step
            width += step
        low, most = (mid, most) if near & added else (low, mid - 1)
    return low


def _short(lengths: list[int], counts: list[int], budget: int) -> int:
    """Tokens that every choice leaves of ``budget`` at least, by the remainders that sums have."""
    least = 0
    often = sorted(zip(counts, lengths), reverse=True)[:_FREQUENT]
    for m in sorted({*range(2, _MODULI), *(math.gcd(n, f) for n in lengths for _, f in often)} - {1}):
        of: dict[int, int] = {}
        for n, c in zip(lengths, counts):
            of[n % m] = of.get(n % m, 0) + c
        ring, reach = (1 << m) - 1, 1
        for r, k in _parts([r or m for r in of], list(of.values()), m * m):
            at = r * k % m
            reach |= (reach << at | reach >> (m - at)) & ring
            if reach == ring:
                break
        least = max(least, next(j for j in range(m) if reach >> (budget - j) % m & 1))
    return least


def exchange(lengths: list[int], taken: list[int], left: list[int], missing: int, window: int = WINDOW) -> list[int]:
    """The changes to ``taken`` after which the least of ``missing`` tokens is missing still.

    ``missing`` is less than any length that is left. Of the best fills take the one that differs
    from ``taken`` by the fewest documents, and walk there: remove one while the sum is above that
    of ``taken``, else add one. The sum never moves up by more than the longest document left, nor
    down by as much as the longest taken, and never recurs, or the steps between could be spared.
    So there are fewer steps than both lengths together, and what they remove is at most the
    product of both. The sums of removed and of added documents up to that product hold a best
    exchange, however large the source is. They grow from ``window`` tokens and end early at an
    exchange that leaves no more than common divisors and remainders of the lengths force.
    """
    used = [i for i in range(len(lengths)) if taken[i] or left[i]]
    unit = math.gcd(*(lengths[i] for i in used)) or 1
    sizes, out, more = [lengths[i] // unit for i in used], [taken[i] for i in used], [left[i] for i in used]
    there, free = (sum(n * k for n, k in zip(sizes, counts)) for counts in (out, more))
    changes = [0] * len(lengths)
    missing //= unit
    if not (there and free and missing):
        return changes
    missing -= _short(sizes, [a + b for a, b in zip(out, more)], there + missing)
    most = min(max(n for n, k in zip(sizes, out) if k) * max(n for n, k in zip(sizes, more) if k), there, free)
    window = min(max(1, window // unit), most)
    while missing:
        removed = _sums(_parts(sizes, out, window), window)
        added = _sums(_parts(sizes, more, window + missing), window + missing)
        if window == most:
            missing = _gain(removed, added, missing)
        if both := added >> missing & removed if missing else 0:
            least = (both & -both).bit_length() - 1
            del removed, added, both
            minus, plus = fill(sizes, out, least), fill(sizes, more, least + missing)
            for i, n in zip(used, sizes):
                changes[i] = plus.get(n, 0) - minus.get(n, 0)
            break
        window = min(4 * window, most)
    return changes


def plan_source(lengths: list[int], counts: list[int], budget: int, cap: int, window: int = WINDOW) -> tuple[int, list[int]]:
    """Whole passes and, for each length, how many documents occur once more."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if total == 0 or budget <= 0 or cap <= 0:
        return 0, [0] * len(lengths)
    passes = min(budget // total, cap)
    whole = rest = budget - passes * total
    if passes == cap or rest == 0:
        return passes, [0] * len(lengths)
    # twice the longest: whatever the greedy pass leaves is then within the window
    window = max(window, 2 * max(lengths))
    take = [c * rest // total for c in counts]
    rest -= sum(n * k for n, k in zip(lengths, take))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= window:
            break
        k = min(counts[i] - take[i], max(0, rest - window // 2) // lengths[i])
        take[i] += k
        rest -= k * lengths[i]
    extra = fill(lengths, [c - k for c, k in zip(counts, take)], rest)
    take = [k + extra.get(n, 0) for n, k in zip(lengths, take)]
    missing = whole - sum(n * k for n, k in zip(lengths, take))
    if missing:
        # what was taken before may stand in the way of the best fill
        left = [c - k if n <= whole else 0 for n, c, k in zip(lengths, counts, take)]
        take = [k + x for k, x in zip(take, exchange(lengths, take, left, missing, window))]
    return passes, take


def _planner(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens", kind="stable")
        lengths, counts = pdf["n_tokens"].tolist(), pdf["n"].tolist()
        passes, take = plan_source(lengths, counts, int(pdf["budget"].iloc[0]), int(pdf["cap"].iloc[0]), window)
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "passes": np.int64(passes), "take": take})

    return run


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, window: int = WINDOW) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of the chosen documents (copies of at least 1).

    ``sized(doc_id, source, n_tokens)``; ``targets(source, target_share, max_repeats)``; sources
    compare trimmed and in lower case. ``total``: tokens of the mix; by default all tokens of
    the targeted sources.
    """
    scratch = Scratch(sized.sparkSession, "mix")
    label = F.lower(F.trim("source"))
    want = targets.where(F.col("source").isNotNull()).groupBy(label.alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    docs = sized.where(F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0)).select("doc_id", label.alias("source"), "n_tokens").distinct()
    order = F.xxhash64("doc_id", F.lit(seed))
    named = [r[0] for r in want.select("source").limit(_NAMED + 1).collect()]
    # few targets are a predicate, so that no source meets in one task; many are a join
    docs = docs.where(F.col("source").isin(*named)) if len(named) <= _NAMED else docs.join(want.select("source"), "source", "left_semi")
    docs = scratch.keep(scratch.write(docs.withColumn("_h", order).withColumn("_s", F.pmod("_h", F.lit(_SLICES)))))
    sliced = docs.groupBy("source", "n_tokens", "_s").agg(F.count(F.lit(1)).alias("n"))
    sliced = scratch.keep(scratch.write(sliced))
    hist = sliced.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
    if total is None:
        total = hist.agg(F.sum(F.col("n") * F.col("n_tokens"))).first()[0] or 0
    budgets = want.select("source", "cap", F.floor(F.col("share") * F.lit(int(total))).cast("long").alias("budget"))
    plan = hist.join(budgets, "source").groupBy("source").applyInPandas(_planner(window), "source string, n_tokens bigint, passes bigint, take bigint")
    plan = scratch.keep(scratch.write(plan))
    ahead = Window.partitionBy("source", "n_tokens").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.withColumn("_off", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(plan, ["source", "n_tokens"])
    # a slice is taken as a whole, not at all, or (at most one of a length) in part
    offsets = offsets.withColumn("_part", F.col("take") - F.col("_off"))
    chosen = docs.join(offsets.select("source", "n_tokens", "_s", "n", "passes", "_part"), ["source", "n_tokens", "_s"])
    partial = (F.col("_part") > 0) & (F.col("_part") < F.col("n"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "_s").orderBy("_h", "doc_id"))
    split = chosen.where(partial).withColumn("_once", (rank <= F.col("_part")).cast("long"))
    whole = chosen.where(~partial).withColumn("_once", (F.col("_part") >= F.col("n")).cast("long"))
    out = split.unionByName(whole).withColumn("copies", F.col("passes") + F.col("_once"))
    return out.where(F.col("copies") > 0).select("doc_id", "source", "n_tokens", "copies")


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares really reached, one row per target source.

    ``(source, target_share, max_repeats, available_tokens, mixed_tokens, reached_share,
    most_copies)``; a source without documents has zeros.
    """
    label = F.lower(F.trim("source"))
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    have = sized.select("doc_id", label.alias("source"), "n_tokens").distinct().groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    want = targets.groupBy(label.alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    # one row per source: the window's single partition is as small as the table of targets
    every = Window.partitionBy(F.lit(1))
    rows = want.join(have, "source", "left").join(got, "source", "left")
    rows = rows.select("source", "target_share", "max_repeats", zero("available_tokens"), zero("mixed_tokens"), zero("most_copies"))
    all_tokens = F.sum("mixed_tokens").over(every)
    return rows.withColumn("reached_share", F.when(all_tokens > 0, F.col("mixed_tokens") / all_tokens).otherwise(F.lit(0.0)))
