"""Parent-child rows of unknown depth: roots, depths, paths, descendants and cycles.

Method: pointer doubling. Every node holds a pointer to an ancestor and its distance; a round
joins the pointers to themselves, so that the distance doubles. A node is done when its pointer
stands on a root. While an undone node is in a tree, each round finishes at least one (the
shallowest), so a round that finishes none leaves only nodes on a cycle or below one. Such nodes
carry the smallest id met on the way; once a pointer has jumped further than there are undone
nodes, it stands on the cycle and the way from there runs all around it, so that minimum is the
smallest id on the cycle. Rounds grow with the logarithm of the depth.

A round's result is a table in the shared folder, so it survives lost executors and the next plan
sees true sizes; finished nodes are written once, with the round that finished them. A pointer that a large part of the rows share is a hot join key: the side that it is
looked up in is unique, and adaptive execution splits the hot partition.

Defined results: null ends are dropped; exact duplicate and parallel links count once; should a
child have several parents, the smallest id is its parent; a link from an id to itself is a cycle
of length 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _initial(links: DataFrame) -> DataFrame:
    """One row per (hierarchy, node): its parent, or null for a root. One shuffle."""
    l = links.where(F.col("parent").isNotNull() & F.col("child").isNotNull())
    ends = l.select(
        "hierarchy",
        F.explode(
            F.array(
                F.struct(F.col("child").alias("node"), F.col("parent").alias("up")),
                F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("up")),
            )
        ).alias("e"),
    )
    return ends.groupBy("hierarchy", F.col("e.node").alias("node")).agg(F.min("e.up").alias("up"))


class _Doubling:
    """The state of pointer doubling: rows that are done stay in the table of the round that
    finished them; a round writes only those that were undone before it."""

    def __init__(self, scratch: Scratch, first: DataFrame, carry: str, merge: Callable[[Column, Column], Column]) -> None:
        self.scratch, self.carry, self.merge = scratch, carry, merge
        self.steps = [scratch.write(first)]

    @property
    def undone(self) -> DataFrame:
        return self.steps[-1].where(~F.col("done"))

    @property
    def done(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x.where("done") for x in self.steps])

    def jump(self, among: DataFrame | None = None) -> None:
        """Each undone node takes over the pointer of the node it points at (one of ``among``)."""
        state = self.done.unionByName(self.undone) if among is None else among
        seen = state.select("hierarchy", F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("dist").alias("d2"), F.col(self.carry).alias("c2"), F.col("done").alias("done2"))
        moved = self.undone.join(seen, ["hierarchy", "ptr"]).select(
            "hierarchy",
            "node",
            F.col("p2").alias("ptr"),
            (F.col("dist") + F.col("d2")).alias("dist"),
            self.merge(F.col(self.carry), F.col("c2")).alias(self.carry),
            F.col("done2").alias("done"),
        )
        self.steps.append(self.scratch.write(moved))

    def keep(self) -> None:
        for x in self.steps:
            self.scratch.keep(x)


def _start(links: DataFrame, carry: str) -> DataFrame:
    """``(hierarchy, node, ptr, dist, carry, done)``: each node with its parent, a root with itself."""
    up = F.col("up")
    return links.select(
        "hierarchy", "node", F.coalesce(up, "node").alias("ptr"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("node").alias(carry), up.isNull().alias("done")
    )


def _resolve(start: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The nodes of trees ``(hierarchy, node, root, depth)``, and those on or below rings
    ``(hierarchy, node, root)``, or None without any."""
    scratch = Scratch(start.sparkSession, "hierarchy")
    # ptr: the ancestor reached, dist: links jumped, low: least id among the nodes jumped over
    state = _Doubling(scratch, _start(start, "low"), "low", F.least)
    jumped, before = 1, -1
    while True:
        undone = state.undone.count()
        if undone in (0, before):
            break
        before = undone
        state.jump()
        jumped *= 2
    tree = state.done.select("hierarchy", "node", F.col("ptr").alias("root"), F.col("dist").alias("depth"))
    if not undone:
        state.keep()
        return tree, None
    # the rest point at one another only
    while jumped <= undone:
        state.jump(state.undone)
        jumped *= 2
    state.keep()
    rings = state.undone
    least = rings.select("hierarchy", F.col("node").alias("ptr"), F.col("low").alias("root"))
    return tree, rings.select("hierarchy", "node", "ptr").join(least, ["hierarchy", "ptr"]).select("hierarchy", "node", "root")


def resolve(links: DataFrame) -> DataFrame:
    """``(hierarchy, node, root, depth, cyclic)`` of every node in ``links(hierarchy, parent, child)``.

    ``root`` of a cyclic node is the smallest id on its cycle, and its depth is -1.
    """
    tree, rings = _resolve(_initial(links))
    out = tree.withColumn("cyclic", F.lit(False))
    if rings is None:
        return out
    return out.unionByName(rings.select("hierarchy", "node", "root", F.lit(-1).cast("long").alias("depth"), F.lit(True).alias("cyclic")))


def paths(links: DataFrame, separator: str = " > ") -> DataFrame:
    """``(hierarchy, node, root, depth, path)`` with the ids from the root down to the node.

    The same doubling over the trees, with the segments joined as strings; nodes on or below a
    cycle have no path and are left out (:func:`resolve` names them): on a ring the segments
    would double without end.
    """
    scratch = Scratch(links.sparkSession, "paths")
    start = scratch.keep(scratch.write(_initial(links)))
    rings = _resolve(start)[1]
    trees = start if rings is None else start.join(rings, ["hierarchy", "node"], "left_anti")
    state = _Doubling(scratch, _start(trees, "path"), "path", lambda own, above: F.concat_ws(separator, above, own))
    while not state.undone.isEmpty():
        state.jump()
    state.keep()
    return state.done.select("hierarchy", "node", F.col("ptr").alias("root"), F.col("dist").alias("depth"), "path")


def _closure(scratch: Scratch, first: DataFrame, again: bool = False) -> DataFrame:
    """All pairs above the links ``first(hierarchy, ancestor, node, distance)``, each once.

    Doubling: pairs of distance up to ``d`` join the pairs of distance exactly ``d``, which gives
    all pairs up to ``2d`` without a duplicate. ``again``: ancestors may come again, around a
    ring; each counts where it is met first, and no node is its own ancestor. Once a way up meets
    an ancestor again it meets only such, so that a ring ends by itself.
    """
    pairs = scratch.write(first)
    reach = 1
    while True:
        tip = pairs.where(F.col("distance") == reach)
        # from the node's far ancestor on up: shorter pairs that start where a full jump ends
        more = (
            tip.select("hierarchy", "node", F.col("ancestor").alias("mid"))
            .join(pairs.select("hierarchy", F.col("node").alias("mid"), "ancestor", F.col("distance").alias("d2")), ["hierarchy", "mid"])
            .select("hierarchy", "ancestor", "node", (F.col("d2") + reach).alias("distance"))
        )
        if again:
            more = more.where(F.col("ancestor") != F.col("node")).join(pairs, ["hierarchy", "ancestor", "node"], "left_anti")
        added = scratch.write(more)
        if added.isEmpty():
            scratch.drop(added)
            break
        pairs = scratch.replace(pairs, pairs.unionByName(added))
        scratch.drop(added)
        reach *= 2
    return scratch.keep(pairs)


def _first(links: DataFrame, cyclic: DataFrame, how: str) -> DataFrame:
    """The links whose child is (``left_semi``) or isn't (``left_anti``) one of ``cyclic``, as pairs."""
    up = _initial(links).where(F.col("up").isNotNull() & (F.col("up") != F.col("node"))).join(cyclic, ["hierarchy", "node"], how)
    return up.select("hierarchy", F.col("up").alias("ancestor"), "node", F.lit(1).cast("long").alias("distance"))


def descendants(links: DataFrame) -> DataFrame:
    """``(hierarchy, ancestor, node, distance)`` of every node below another, trees only.

    Nodes on or below a ring are excluded first; :func:`all_descendants` has them too.
    """
    cyclic = resolve(links).where("cyclic").select("hierarchy", "node")
    return _closure(Scratch(links.sparkSession, "descendants"), _first(links, cyclic, "left_anti"))


def all_descendants(links: DataFrame) -> DataFrame:
    """``(hierarchy, ancestor, node, distance)`` of every node below another, rings included.

    The trees below a ring are listed like any other; the members of the ring are ancestors of
    them and of one another, each at its least distance.
    """
    cyclic = resolve(links).where("cyclic").select("hierarchy", "node")
    trees = _closure(Scratch(links.sparkSession, "descendants"), _first(links, cyclic, "left_anti"))
    return trees.unionByName(_closure(Scratch(links.sparkSession, "rings"), _first(links, cyclic, "left_semi"), again=True))
