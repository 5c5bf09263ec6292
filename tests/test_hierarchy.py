import random

from symgraph.operators import hierarchy as H

from .conftest import rows


def links(spark, pairs, h="h"):
    return spark.createDataFrame([(h, p, c, 1) for p, c in pairs], "hierarchy string, parent string, child string, node int")


def brute(pairs):
    up = {}
    for p, c in pairs:
        up[c] = min(p, up.get(c, p))
    out = {}
    for x in {i for pc in pairs for i in pc}:
        seen, at = [x], x
        while at in up and up[at] not in seen:
            at = up[at]
            seen.append(at)
        if at in up:
            ring = seen[seen.index(up[at]) :]
            out[x] = (min(ring), -1)
        else:
            out[x] = (at, len(seen) - 1)
    return out


def test_random_forests_with_rings(spark):
    rnd = random.Random(4)
    for n in (1, 7, 40, 150):
        ids = [f"n{i:03}" for i in range(n + 1)]
        pairs = [(rnd.choice(ids), c) for c in ids if rnd.random() < 0.85]
        got = {r[0]: (r[1], r[2]) for r in rows(H.resolve(links(spark, pairs)), "node", "root", "depth")}
        assert got == brute(pairs)


def test_long_chain_and_tails(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(130)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r2", "t1"), ("t1", "t2"), ("s", "s")]
    got = {r[0]: (r[1], r[2]) for r in rows(H.resolve(links(spark, chain + ring)), "node", "root", "depth")}
    assert got["c130"] == ("c0", 130) and got["t2"] == ("r1", -1) and got["s"] == ("s", -1)


def test_paths_and_descendants(spark):
    pairs = [("a", "b"), ("b", "c"), ("b", "d"), ("x", "y"), ("y", "x"), ("y", "z")]
    got = {r[0]: r[1] for r in rows(H.paths(links(spark, pairs), "/"), "node", "path")}
    assert got == {"a": "a", "b": "a/b", "c": "a/b/c", "d": "a/b/d"}
    assert rows(H.descendants(links(spark, pairs)), "ancestor", "node", "distance") == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]
    deep = H.descendants(links(spark, [(f"c{i}", f"c{i + 1}") for i in range(20)]))
    assert deep.count() == 210 and deep.distinct().count() == 210


def test_nulls_duplicates_and_nothing(spark):
    assert rows(H.resolve(links(spark, []))) == []
    assert rows(H.paths(links(spark, []))) == []
    assert rows(H.descendants(links(spark, []))) == []
    odd = links(spark, [("a", "b"), ("a", "b"), (None, "b"), ("a", None)])
    assert rows(H.resolve(odd), "node", "root", "depth") == [("a", "a", 0), ("b", "a", 1)]


def test_descendants_on_and_below_rings(spark):
    rnd = random.Random(8)
    below = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("s", "s"), ("s", "t")]
    got = rows(H.all_descendants(links(spark, below)), "ancestor", "node", "distance")
    assert ("z", "w", 1) in got and ("x", "w", 3) in got and ("y", "x", 1) in got and ("s", "t", 1) in got and ("s", "s", 1) not in got
    ids = [f"n{i:03}" for i in range(61)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 21:02}") for i in range(21)] + [("r03", "n000")]
    for pairs in (below, ring, [(rnd.choice(ids), c) for c in ids if rnd.random() < 0.9] + ring):
        up = {}
        for p, c in pairs:
            up[c] = min(p, up.get(c, p))
        want = []
        for x in up:
            at, seen = up[x], [x]
            while at is not None and at not in seen:
                want.append((at, x, len(seen)))
                seen.append(at)
                at = up.get(at)
        assert rows(H.all_descendants(links(spark, pairs)), "ancestor", "node", "distance") == sorted(want, key=repr)
    assert rows(H.all_descendants(links(spark, []))) == []
