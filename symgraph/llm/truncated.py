"""Texts that stop before their end, and how often each source cuts.

Method: search for values that are strict prefixes of longer copies elsewhere, at three sizes.

* *Texts.* All bodies (without blanks and marks of a cut at the end) are sorted by range; those
  that are strict prefixes of a text stand before it and are kept as a stack, over the bounds of
  ranges as well. A prefix counts where a longer copy goes on within the word or the sentence; where
  that is open (before a name, number or quotation), if no copy shows a whole title or sentence.
* *Words.* The last word of a text is looked up among the hashed beginnings of all longer words
  that follow the same token anywhere: a fragment that is never a word of its own was cut.
* *Sequences.* The last tokens of a text (after two others, in the frame of its line, after one,
  alone) are looked up among all token sequences of the corpus: if they practically always go on
  and neither lines nor other texts end with them, the text was cut. Behind a full stop only an
  adjacent follower goes on (``version 4.`` of ``version 4.2``).

Code that its grammar accepts as whole is judged by words only. Besides, a text that leaves a fence, bracket, quote, string, block or statement open is cut.
Sign-offs, titles, list items and dots set on purpose end other texts and lines as well, so they
have counts as ends.

A longer copy, where there is one, decides; the other evidence is for texts without. Statistics
cover all texts. The endings of texts are known first; a filter of fixed size tells workers which
contexts and beginnings are asked for, so that no others leave them, and verdicts are reached once
per distinct ending, so that no ending that many texts share is a hot key with more than a narrow
row per text. The filter is a bitmap of at most ``BITS`` bits and only spares work: what it lets
pass by mistake is dropped by the join with the endings.

The thresholds of verdicts were set by reading the endings found in the project's own data, not
fitted on labels, of which there are none; they are parameters of the language, not of a source.

Defined results: null, empty and blank texts are whole; a text under several ids has one verdict;
extra columns are ignored.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import Scratch
from .contexts import FRAME, TERMINATORS, Filter, observe, tokenise
from .tails import body, left_open, lines, looks_like_code, tokens

#: The most bits of the filter of asked keys (16 MB), and bits per key below that.
BITS = 1 << 27
BITS_PER_KEY = 16
#: Bits of a row of a bitmap under construction, as Spark's bitmap functions have it.
_ROW = 32768


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


_TAIL = "doc_id bigint, source string, body bigint, open string, code boolean, title boolean, stop boolean, word boolean, k3 bigint, k4 bigint, k2 bigint, k1 bigint, p2 bigint, p1 bigint"
_ENDING = ["code", "title", "stop", "word", "k3", "k4", "k2", "k1", "p2", "p1"]
_SLOTS = ["k3", "k4", "k2", "k1", "p2", "p1"]


def _plain(text: str) -> str:
    return body(text).replace("\r\n", "\n").replace("\r", "\n")


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _TAIL.split(", ")]
    for pdf in batches:
        out, ends, one_line = [], [], []
        for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
            if not isinstance(text, str):
                continue
            text = body(text)
            rows = lines(text)
            if not rows:
                continue
            code = looks_like_code(rows)
            out.append((doc, source, _h(text), left_open(text, rows, code), code))
            ends.append(rows[-1])
            one_line.append(len(rows) == 1)
        t = tokenise("\n".join(ends))
        at = np.flatnonzero(t.last)
        columns = dict(zip(names[:5], zip(*out))) if out else {n: () for n in names[:5]}
        frame = pd.DataFrame({n: pd.array(list(c), dtype="Int64") if n in ("doc_id", "body") else pd.Series(list(c), dtype=object) for n, c in columns.items()})
        frame["title"] = np.array(one_line, bool) & (t.place[at] + 1 < FRAME)
        frame["stop"], frame["word"] = t.ends[at], t.alpha[at]
        whole = dict(zip(("p2", "p1"), t.whole(at)))
        for n in _SLOTS:
            keys = pd.array((whole[n] if n in whole else t.keys[n][at]).view(np.int64), dtype="Int64")
            if n in ("k4", "p2", "p1"):
                keys[~(t.framed if n == "k4" else t.alpha)[at]] = pd.NA
            frame[n] = keys
        yield frame[names]


def _filter(keys: DataFrame) -> bytes:
    """A bitmap of ``keys(key)``, built in rows of 4 KB by executors; at most ``BITS`` bits."""
    n = keys.count()
    bits = _ROW
    while bits < min(BITS, BITS_PER_KEY * n):
        bits *= 2
    low = F.col("key").bitwiseAND(F.lit(bits - 1).cast("long"))
    rows = keys.select(low.alias("b")).groupBy(F.floor(F.col("b") / _ROW).cast("int").alias("row")).agg(F.bitmap_construct_agg((F.col("b") % _ROW)).alias("bits"))
    out = bytearray(bits // 8)
    for row, part in rows.collect():  # at most BITS of them
        out[row * (_ROW // 8) : (row + 1) * (_ROW // 8)] = part
    return bytes(out)


def _observations(bits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = Filter(bits.value)
        for pdf in batches:
            keys, on, end, begun = observe([b for t in pdf["text"] if isinstance(t, str) and (b := _plain(t))], wanted)
            yield pd.DataFrame({"key": keys.view(np.int64), "f": on, "e": end, "p": begun})

    return run


#: Evidence of a continuation: within the word or sentence, perhaps within it, behind a whole title or sentence.
STRONG, WEAK, AGAINST = 1, 2, 4
#: A line from this length on may have been wrapped.
WRAPPED = 40
_EDGE = "pid int, first boolean, last boolean, body bigint, text string, kind int"


def _goes_on(short: str, longer: str) -> int:
    """How ``longer`` continues ``short``: ``STRONG``, ``WEAK``, ``AGAINST``, or 0 for no sign of either.

    Before a name, a number, a quotation or a wrapped line a sentence may go on or a new one begin.
    """
    if len(longer) <= len(short) or not longer.startswith(short):
        return 0
    a, rest = short[-1:], longer[len(short) :]
    if a.isalnum() and rest[0].isalnum():
        return STRONG
    if a in TERMINATORS:
        return AGAINST
    follower = rest.lstrip(" \t")
    title = "\n" not in short and len(tokens(short)) < FRAME
    if follower[:1].islower():
        # what a body follows in another text is a title, and a name in lower case may begin a sentence
        return WEAK if title else STRONG
    if follower[:1] in ("\r", "\n"):
        wrapped = follower.removeprefix("\r").removeprefix("\n")
        if wrapped[:1] in ("\r", "\n"):
            return AGAINST
        last = short[short.rfind("\n") + 1 :]
        return WEAK if wrapped[:1].islower() and len(last) >= WRAPPED and not looks_like_code(lines(short)) else 0
    # behind a smiley or closing sign, and behind a title in its line, a sentence begins
    if follower[:1] in TERMINATORS + "…" or not any(c.isalnum() for c in follower) or not (a.isalnum() or a in ",;") or (title and follower[:1].isupper()):
        return 0
    return WEAK


def _sorted_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares each text of a sorted partition with all that are prefixes of it.

    These are a stack, each a prefix of the next. What is on it at the end is left to the caller,
    who may have to compare it with texts of later partitions, so that every text comes out too.
    """
    stack: list[list] = []  # body, text, kinds
    pid, first = None, True
    cols = [x.split()[0] for x in _EDGE.split(", ")]
    for pdf in batches:
        out = []
        for pid, h, text in zip(pdf["pid"], pdf["body"], pdf["text"]):
            while stack and not text.startswith(stack[-1][1]):
                done = stack.pop()
                if done[2]:
                    out.append((pid, False, False, done[0], None, done[2]))
            if stack and stack[-1][1] == text:
                continue
            for x in stack:
                if not x[2] & STRONG:
                    x[2] |= _goes_on(x[1], text)
            stack.append([h, text, 0])
            out.append((pid, first, False, h, text, 0))
            first = False
        yield pd.DataFrame(out, columns=cols)
    if stack:
        yield pd.DataFrame([(pid, False, True, h, text, kind) for h, text, kind in stack], columns=cols)


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = {_h(b): b for t in pdf["text"] if isinstance(t, str) and (b := body(t))}
        yield pd.DataFrame({"body": pd.Series(list(texts), dtype="int64"), "text": list(texts.values())})


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length of the beginning that two texts have in common (0 with none)."""
    return pd.Series([len(os.path.commonprefix([x, y])) if isinstance(x, str) and isinstance(y, str) else 0 for x, y in zip(a, b)], dtype="int64")


def _reach(within: dict[int, int], over: dict[int, tuple[int, int]]):
    """How far the texts of each partition's last chain of prefixes go on being prefixes.

    ``within``: what the first and last text of a partition have in common; ``over``: of each
    partition the next, and what its first text has in common with the last one of this. In
    sorted order a text is a prefix of a later one iff it is no longer than all these on the way.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pid, h, size in zip(pdf["pid"], pdf["body"], pdf["size"]):
                at = pid
                while at in over and size <= over[at][1]:
                    at = over[at][0]
                    out.append((at, h))
                    if size > within[at]:
                        break
            yield pd.DataFrame(out, columns=["pid", "body"]).astype({"pid": "int32", "body": "int64"})

    return run


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kinds = [_goes_on(a, b) for a, b in zip(pdf["short"], pdf["text"])]
        yield pd.DataFrame({"body": pdf["body"], "kind": pd.Series(kinds, dtype="int32")})


def prefix_texts(docs: DataFrame) -> DataFrame:
    """``body`` hashes of the texts that a longer text elsewhere continues mid-word or mid-sentence.

    All longer texts count: one that goes on within the sentence decides, one that perhaps does
    only if none has a whole title or sentence before it. Copies are one text before they are
    sorted. Of partitions only numbers meet: two lengths each.
    """
    texts = docs.select("text").where(F.col("text").isNotNull()).mapInPandas(_bodies, "body bigint, text string")
    texts = texts.groupBy("body").agg(F.first("text").alias("text"))
    found = Scratch(docs.sparkSession, "prefixes")
    ordered = texts.repartitionByRange("text").sortWithinPartitions("text").withColumn("pid", F.spark_partition_id())
    rows = found.keep(found.write(ordered.mapInPandas(_sorted_prefixes, _EDGE)))
    first = rows.where("first").select("pid", "text")
    chain = rows.where("last").select("pid", "body", "text", F.length("text").alias("size"))
    top = chain.groupBy("pid").agg(F.max_by("text", "size").alias("end"))
    # a row per partition, numbers only
    after = first.select("pid", F.lead("pid").over(Window.orderBy("pid")).alias("next"))
    ends = top.join(first.withColumnRenamed("text", "begin"), "pid").join(after, "pid").join(first.select(F.col("pid").alias("next"), F.col("text").alias("then")), "next", "left")
    met = ends.select("pid", "next", _common("begin", "end").alias("within"), _common("end", "then").alias("over")).collect()
    reach = _reach({r["pid"]: r["within"] for r in met}, {r["pid"]: (r["next"], r["over"]) for r in met if r["next"] is not None})
    carried = chain.select("pid", "body", "size").mapInPandas(reach, "pid int, body bigint").join(chain.select("body", F.col("text").alias("short")), "body")
    carried = found.keep(found.write(carried))
    over = rows.where("text is not null and not last").select("pid", "text").join(carried, "pid").where(F.col("text").startswith(F.col("short"))).mapInPandas(_kinds, "body bigint, kind int")
    kinds = rows.where("kind > 0").select("body", "kind").unionByName(over).groupBy("body").agg(F.bit_or("kind").alias("kind"))
    sure = F.col("kind").bitwiseAND(STRONG) > 0
    return kinds.where(sure | (F.col("kind").bitwiseAND(WEAK | AGAINST) == WEAK)).select("body")


def _verdict() -> Column:
    """From the evidence of an ending (the text itself not counted among ends of texts)."""

    def own(n: str) -> tuple[Column, Column, Column]:
        f, e, t = (F.coalesce(F.col(f"{x}{n}"), F.lit(0)) for x in ("f", "e", "t"))
        return f, e, F.greatest(t - 1, F.lit(0))

    out = F.lit(None).cast("string")
    # from the widest context to the narrowest, so that the narrowest decides
    for n, least in (("1", 20), ("2", 3), ("4", 3), ("3", 3)):
        f, e, t = own(n)
        # behind a full stop only two contexts are narrow enough; in a text of a few words, where
        # the frame of the line is known to be rare, the wide ones need more
        least = F.when(F.col("title"), 20).otherwise(least) if n in "12" else F.lit(least)
        enough = (f + e + t >= least) & (~F.col("stop") | F.lit(n in "23"))
        goes = (f >= least) & (e <= 0.02 * f) & (t <= 0.03 * f + F.when(f >= 20, 2).otherwise(1))
        stopped = (f >= least) & (e + t <= 0.05 * f)
        out = F.when(enough, F.when(F.when(F.col("stop"), stopped).otherwise(goes), F.lit("sequence"))).otherwise(out)
    # code that is whole by its grammar ends a statement, whatever may follow its last name; a
    # word that by itself often ends lines and texts is a sign-off
    f, e, t = own("1")
    out = F.when(~F.col("code") & (F.col("stop") | (e + t <= 0.3 * f + 2)), out)
    for n in ("1", "2"):
        f, e, t = own(n)
        p = F.coalesce(F.col(f"pre{n}"), F.lit(0))
        out = F.when(F.col("word") & (p >= 1) & (f + e == 0) & (t <= 0.02 * p + 2), F.lit("word")).otherwise(out)
    return out


def _evidence(texts: DataFrame, tails: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, f, e, p, t)`` of all keys of undecided endings: see :func:`observe`; ``t`` texts end so."""
    keys = lambda df, *slots: F.explode(F.filter(F.array(*slots), lambda k: k.isNotNull())).alias("key")
    asked = tails.where(F.col("open").isNull()).select(*_SLOTS).distinct()
    asked = scratch.keep(scratch.write(asked.select(keys(asked, *_SLOTS)).distinct()))
    bits = texts.sparkSession.sparkContext.broadcast(_filter(asked))
    none = F.lit(0).cast("long")
    seen = texts.where(F.col("text").isNotNull()).mapInPandas(_observations(bits), "key bigint, f bigint, e bigint, p bigint").withColumn("t", none)
    # ends of texts, a text under several ids once
    ends = tails.select("body", *_SLOTS[:4]).distinct()
    ends = ends.select(keys(ends, *_SLOTS[:4]), none.alias("f"), none.alias("e"), none.alias("p"), F.lit(1).cast("long").alias("t"))
    total = seen.unionByName(ends).groupBy("key").agg(*[F.sum(c).alias(c) for c in "fept"])
    return total.join(asked, "key", "left_semi")


def judge(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, reason)`` of every row with a text; a null ``reason`` for a whole text.

    ``docs(doc_id, text, source)``. Reasons: ``copy`` (a longer copy goes on), ``open``, ``word``,
    ``sequence``.
    """
    scratch = Scratch(docs.sparkSession, "truncated")
    narrow = docs.select("doc_id", "source", "text")
    tails = scratch.keep(scratch.write(narrow.mapInPandas(_tails, _TAIL).withColumn("ending", F.xxhash64(*_ENDING))))
    stats = scratch.keep(scratch.write(_evidence(narrow.select("text"), tails, scratch)))
    endings = tails.where(F.col("open").isNull()).groupBy("ending").agg(*[F.first(c).alias(c) for c in _ENDING])
    # one join for all slots, then the evidence of an ending in one row
    slots = endings.select("ending", F.explode(F.filter(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("key")) for s in _SLOTS]), lambda x: x["key"].isNotNull())).alias("x"))
    slots = slots.select("ending", "x.slot", "x.key").join(stats, "key")
    names = {"k3": "3", "k4": "4", "k2": "2", "k1": "1"}
    of = lambda slot, c, name: F.max(F.when(F.col("slot") == slot, F.col(c))).alias(name)
    known = slots.groupBy("ending").agg(*[of(s, c, f"{c}{n}") for s, n in names.items() for c in "fet"], of("p2", "p", "pre2"), of("p1", "p", "pre1"))
    judged = endings.select("ending", "code", "title", "stop", "word").join(known, "ending")
    cut = judged.withColumn("why", _verdict()).where(F.col("why").isNotNull()).select("ending", "why")
    copies = prefix_texts(narrow).withColumn("copy", F.lit(True))
    # both right sides are unique, and rare by definition
    out = tails.select("doc_id", "source", "body", "open", "ending").join(cut, "ending", "left").join(copies, "body", "left")
    reason = F.when(F.col("copy"), "copy").when(F.col("open").isNotNull(), "open").otherwise(F.col("why"))
    return out.select("doc_id", "source", reason.alias("reason")).distinct()


def rates(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``(source, documents, truncated, rate)`` over all rows, null texts included."""
    label = F.nullif(F.lower(F.trim("source")), F.lit(""))
    cut = judged.where(F.col("reason").isNotNull()).select("doc_id").distinct().withColumn("_cut", F.lit(1))
    rows = docs.select("doc_id", label.alias("source")).distinct().join(cut, "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count("_cut").alias("truncated"), (F.count("_cut") / F.count(F.lit(1))).alias("rate")
    )
