"""Graph operators: bounded reach, impact, hierarchies of classes, shortest paths, walks.

Loops run level by level over a frontier table; each level is one join with the edges and one
anti-join with what was visited, written to the shared folder. Seeds are carried along, so one
loop serves any number of seeds. Ties end in the id; null ends are dropped; rings end because a
visited node is not visited again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P
from ..session import Growing, Scratch


def links(edges: DataFrame, kinds: tuple[str, ...], reverse: bool = False) -> DataFrame:
    """Distinct ``(src, dst)`` along kinds of edges."""
    a, b = ("target", "source") if reverse else ("source", "target")
    e = edges.where(F.col("kind").isin(*kinds) & F.col("source").isNotNull() & F.col("target").isNotNull())
    return e.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


#: Levels after which seeds that have reached enough are looked for.
_LOOK = 4


def reach(seeds: DataFrame, steps: DataFrame, depth: int, most: int | None = None, leaf: Column | None = None, small: int = 1_000_000) -> DataFrame:
    """``(seed, node, depth, truncated)``: what each ``(seed, node)`` reaches within ``depth``.

    ``steps(src, dst, ...)``; ``leaf``: steps whose far end is recorded but not walked on from,
    unless another step of the same level leads there. ``most``: a seed that has reached so many
    nodes stops, keeps its first ones by depth and id, and is marked; from ``small`` rows of state on
    levels are cut to as many rows of a seed before they are written, with the same result.
    """
    scratch = Scratch(seeds.sparkSession, "reach")
    steps = scratch.keep(scratch.write(steps.withColumn("leaf", leaf if leaf is not None else F.lit(False)).select("src", "dst", "leaf")))
    first = seeds.select("seed", "node").where(F.col("node").isNotNull()).distinct()
    visited = Growing(scratch, first.select("seed", "node", F.lit(0).alias("depth"), F.lit(False).alias("leaf")))
    full: DataFrame | None = None
    crowded = lambda: scratch.keep(scratch.write(visited.df.groupBy("seed").count().where(F.col("count") > most).select("seed")))
    for level in range(1, depth + 1):
        frontier = visited.last.where(~F.col("leaf"))
        if full is not None:
            frontier = frontier.join(full.select("seed"), "seed", "left_anti")
        step = frontier.select("seed", F.col("node").alias("src")).join(steps, "src")
        found = step.groupBy("seed", F.col("dst").alias("node")).agg(F.min("leaf").alias("leaf"))
        found = found.join(visited.df.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("depth"), "leaf")
        # cut within the level: no more rows of a seed can be among its first ones (spared while all is small)
        if most is not None and visited.total > small:
            found = found.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("n") <= most + 1).drop("n")
        if not visited.add(found):
            break
        # a level adds at most ``most`` and one, so to look now and then bounds the state as well
        if most is not None and visited.total > most and level % _LOOK == 0:
            full = crowded()
    if most is not None and visited.total > most:
        full = crowded()
    out = visited.keep().select("seed", "node", "depth")
    if full is None or full.isEmpty():
        return out.withColumn("truncated", F.lit(False))
    cut = out.join(full, "seed", "left_semi")
    w = Window.partitionBy("seed").orderBy("depth", "node")
    kept = cut.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("seed", "node", "depth", F.lit(True).alias("truncated"))
    return out.join(full, "seed", "left_anti").withColumn("truncated", F.lit(False)).unionByName(kept)


def _listed(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each seed; ``truncated`` marks seeds that had more."""
    w = Window.partitionBy("seed").orderBy(*order)
    # one row more than listed tells that there are more; the limit acts before the shuffle
    ranked = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most + 1)
    marked = ranked.withColumn("truncated", F.max("n").over(Window.partitionBy("seed")) > most)
    return marked.where(F.col("n") <= most).drop("n")


def impact(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, most: int = 5000) -> DataFrame:
    """``(seed, level, node, kind, reached, truncated)``: who is affected if a symbol changes.

    Callers level by level, without containment, files and tests. The strongest edge by which a
    level finds a node decides: kinds that carry behaviour are reached and walked on from, others
    are associations, which are listed at the first level and never walked on from.
    """
    scratch = Scratch(seeds.sparkSession, "impact")
    about = nodes.where((F.col("kind") != "file") & ~P.is_test_path("file_path")).select(F.col("id").alias("source"))
    calls = edges.where(F.col("kind") != "contains").select("source", "target", "kind").distinct().join(about, "source", "left_semi")
    calls = scratch.keep(scratch.write(calls.select(F.col("target").alias("src"), F.col("source").alias("dst"), "kind")))
    first = seeds.select("seed", "node").distinct()
    seen = Growing(scratch, first.select("seed", "node", F.lit(0).alias("level"), F.lit("").alias("kind"), F.lit(True).alias("reached")))
    for level in range(1, depth + 1):
        frontier = seen.last.where("reached").select("seed", F.col("node").alias("src"))
        best = F.min(F.struct(P.edge_rank("kind").alias("r"), F.col("kind"))).alias("b")
        found = frontier.join(calls, "src").groupBy("seed", F.col("dst").alias("node")).agg(best)
        found = found.join(seen.df.select("seed", "node"), ["seed", "node"], "left_anti")
        found = found.select("seed", "node", F.lit(level).alias("level"), F.col("b.kind").alias("kind"), F.col("b.kind").isin(*D.REACH_KINDS).alias("reached"))
        if not seen.add(found):
            break
    state = seen.keep()
    listed = state.where((F.col("level") > 0) & (F.col("reached") | (F.col("level") == 1)))
    return _listed(listed, ["level", P.edge_rank("kind"), "node"], most)


def subclasses(edges: DataFrame, depth: int = 16) -> DataFrame:
    """``(base, sub, depth)`` for every class that something extends."""
    steps = links(edges, ("extends",), reverse=True)
    seeds = steps.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    return reach(seeds, steps, depth).where(F.col("depth") > 0).select(F.col("seed").alias("base"), F.col("node").alias("sub"), "depth")


def superclasses(edges: DataFrame, depth: int = 16, of: DataFrame | None = None) -> DataFrame:
    """``(sub, base, depth)``, the class itself at depth 0. ``of(id)``: only for these classes."""
    steps = links(edges, ("extends",))
    seeds = steps.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    if of is not None:
        seeds = seeds.join(of.select(F.col("id").alias("seed")), "seed", "left_semi")
    return reach(seeds, steps, depth).select(F.col("seed").alias("sub"), F.col("node").alias("base"), "depth")


def model_fields(edges: DataFrame, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(model, field, name, base, depth, shadowed)``: effective fields of models and classes.

    Own fields come first, then inherited ones by base name and line; a later field of a name
    already taken is shadowed. ``of(id)``: only for these, whose bases alone are climbed.
    """
    kinds = nodes.where(F.col("kind").isin("class", "model")).select("id", F.col("name").alias("base_name"))
    held = edges.where(F.col("kind") == "contains").select("source", "target").distinct()
    fields = nodes.where(F.col("kind") == "field").select(F.col("id").alias("target"), "name", "start_line")
    owned = held.join(fields, "target").select(F.col("source").alias("base"), F.col("target").alias("field"), "name", "start_line")
    supers = superclasses(edges, of=of)
    asked = kinds if of is None else kinds.join(of.select("id"), "id", "left_semi")
    every = asked.select(F.col("id").alias("sub"), F.col("id").alias("base"), F.lit(0).alias("depth")).unionByName(supers).groupBy("sub", "base").agg(F.min("depth").alias("depth"))
    every = every.join(asked.select(F.col("id").alias("sub")), "sub", "left_semi").join(kinds.select(F.col("id").alias("base"), "base_name"), "base", "left")
    rows = every.join(owned, "base")
    w = Window.partitionBy("sub", "name").orderBy(F.when(F.col("depth") == 0, 0).otherwise(1), "base_name", "start_line", "field")
    return rows.withColumn("n", F.row_number().over(w)).select(F.col("sub").alias("model"), "field", "name", "base", "depth", (F.col("n") > 1).alias("shadowed"))


def inherited_methods(edges: DataFrame, nodes: DataFrame, depth: int = 16) -> DataFrame:
    """``(cls, name, method)``: the one inherited method a class answers a name with.

    Only the shallowest depth that defines the name counts, and only if it has exactly one
    definition there; otherwise the class abstains.
    """
    held = edges.where(F.col("kind") == "contains").select("source", "target").distinct()
    methods = nodes.where(F.col("kind") == "method").select(F.col("id").alias("target"), "name")
    owned = held.join(methods, "target").select(F.col("source").alias("base"), F.col("target").alias("method"), "name")
    at = superclasses(edges, depth).where(F.col("depth") > 0).join(owned, "base").groupBy(F.col("sub").alias("cls"), "name", "depth")
    at = at.agg(F.count_distinct("method").alias("n"), F.min("method").alias("method"))
    best = at.groupBy("cls", "name").agg(F.min(F.struct("depth", "n", "method")).alias("b")).where(F.col("b.n") == 1)
    return best.select("cls", "name", F.col("b.method").alias("method"))


def overrides(edges: DataFrame, nodes: DataFrame, depth: int = 16) -> DataFrame:
    """``(source, target)``: each method and the nearest method of its name up its classes.

    Nearest by depth, ties by the smallest id.
    """
    held = edges.where(F.col("kind") == "contains").select("source", "target").distinct()
    methods = nodes.where(F.col("kind") == "method").select(F.col("id").alias("target"), "name")
    owned = held.join(methods, "target").select(F.col("source").alias("cls"), F.col("target").alias("method"), "name")
    above = superclasses(edges, depth).where(F.col("depth") > 0)
    mine = owned.join(above.select(F.col("sub").alias("cls"), "base", "depth"), "cls")
    theirs = owned.select(F.col("cls").alias("base"), F.col("method").alias("target"), "name")
    hit = mine.join(theirs, ["base", "name"]).where(F.col("method") != F.col("target"))
    return hit.groupBy(F.col("method").alias("source")).agg(F.min(F.struct("depth", "target")).alias("b")).select("source", F.col("b.target").alias("target"))


def _spread(sources: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``(source, node, path, hops)``: a shortest path from each of ``sources(source)`` to all
    that it reaches; of several the smallest (as an array of ids)."""
    scratch = Scratch(sources.sparkSession, "paths")
    steps = scratch.keep(scratch.write(links(edges, D.PATH_KINDS)))
    seen = Growing(scratch, sources.select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path"), F.lit(0).alias("hops")))
    for level in range(1, hops + 1):
        step = seen.last.join(steps, F.col("node") == F.col("src"))
        # the path is extended after the choice: it is fixed by its predecessor
        found = step.groupBy("source", F.col("dst").alias("node")).agg(F.min("path").alias("before"))
        found = found.join(seen.df.select("source", "node"), ["source", "node"], "left_anti")
        if not seen.add(found.select("source", "node", F.concat("before", F.array("node")).alias("path"), F.lit(level).alias("hops"))):
            break
    return seen.keep()


def shortest_paths(pairs: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """``(source, target, hops, path)`` of a shortest directed path between each pair.

    Breadth first from the sources of all pairs at once. A pair without a path within ``hops`` is
    missing.
    """
    ask = pairs.select("source", "target").where(F.col("source") != F.col("target")).distinct()
    state = _spread(ask, edges, hops)
    return ask.join(state.where(F.col("hops") > 0).withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", "hops", "path")


def connect(groups: DataFrame, edges: DataFrame, most: int = 6, hops: int = 6) -> DataFrame:
    """Shortest paths among named groups ``(name, id)``, the best per ordered pair of names.

    A group is what a name may mean. All groups spread at once, and what they reach is looked up
    among the groups by its id, so the members of two groups are never paired. Pairs of an owner
    and its own member are left out.
    """
    groups = groups.select("name", "id").distinct()
    state = _spread(groups.select(F.col("id").alias("source")), edges, hops).where(F.col("hops") > 0)
    met = state.join(groups.select(F.col("name").alias("to_name"), F.col("id").alias("node")), "node")
    met = met.join(groups.select(F.col("name").alias("from_name"), F.col("id").alias("source")), "source").where(F.col("from_name") != F.col("to_name"))
    met = met.where(~F.startswith("node", F.concat("source", F.lit("."))) & ~F.startswith("source", F.concat("node", F.lit("."))))
    best = met.groupBy("from_name", "to_name").agg(F.min(F.struct("hops", "path")).alias("b"))
    return best.select("from_name", "to_name", F.col("b.hops").alias("hops"), F.col("b.path").alias("path")).orderBy("hops", "path").limit(most)


def feature(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 3, most: int = 60) -> DataFrame:
    """``(seed, node, level, truncated)``: the vertical slice through the layers around each seed.

    Downward by ten kinds, by plain calls only from the seeds (and from the view that a route
    names) into data layers; four kinds lead on. Upward by three kinds, from the seeds only.
    """
    down = ("routes_to", "renders", "extends_template", "includes_template", "relates_to", "instantiates", "extends", "receives", "handles", "resolves")
    chain = ("routes_to", "renders", "extends_template", "includes_template")
    role = P.symbol_role("kind", "name", "file_path")
    data = nodes.where((F.col("kind") == "model") | role.isin("service", "queryset", "form", "serializer", "model")).select(F.col("id").alias("dst"), F.lit(True).alias("data"))
    scratch = Scratch(seeds.sparkSession, "feature")
    known = nodes.select(F.col("id").alias("dst"))
    e = edges.where(F.col("kind").isin(*down, "calls")).select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind").distinct()
    steps = scratch.keep(scratch.write(e.join(known, "dst", "left_semi").join(data, "dst", "left").select("src", "dst", "kind", F.coalesce("data", F.lit(False)).alias("data"))))
    first = seeds.select("seed", "node").distinct()
    seen = Growing(scratch, first.select("seed", "node", F.lit(0).alias("level"), F.lit(True).alias("leads"), F.lit(True).alias("calls")))
    for level in range(1, depth + 1):
        frontier = seen.last.where("leads").select("seed", F.col("node").alias("src"), "calls")
        step = frontier.join(steps, "src").where((F.col("kind") != "calls") | (F.col("calls") & F.col("data")))
        found = step.groupBy("seed", F.col("dst").alias("node")).agg(F.max(F.col("kind").isin(*chain)).alias("leads"), F.max(F.col("kind") == "routes_to").alias("calls"))
        found = found.join(seen.df.select("seed", "node"), ["seed", "node"], "left_anti")
        if not seen.add(found.select("seed", "node", F.lit(level).alias("level"), "leads", "calls")):
            break
    state = seen.keep()
    up = edges.where(F.col("kind").isin("routes_to", "renders", "relates_to")).select(F.col("target").alias("n0"), F.col("source").alias("node")).distinct()
    above = first.withColumnRenamed("node", "n0").join(up, "n0").select("seed", "node").distinct().join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    above = above.join(state.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(-1).alias("level"))
    every = state.select("seed", "node", "level").unionByName(above)
    return _listed(every, [F.abs("level"), F.desc("level"), "node"], most)


def template_ancestry(edges: DataFrame, nodes: DataFrame, depth: int = 8) -> DataFrame:
    """``(template, ancestor, depth)``: views and templates that lead to a template."""
    steps = links(edges, ("renders", "includes_template", "extends_template"), reverse=True)
    seeds = nodes.where(F.col("kind") == "template").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return reach(seeds, steps, depth).where(F.col("depth") > 0).select(F.col("seed").alias("template"), F.col("node").alias("ancestor"), "depth")


def owners(nodes: DataFrame) -> DataFrame:
    """``(member, owner)`` by trimming the last part of the qualified name, within a project."""
    n = nodes.select("id", "project_id", "qualified_name")
    m = n.select(F.col("id").alias("member"), "project_id", P.owner_name("qualified_name").alias("up")).where(F.col("up").isNotNull())
    o = n.select(F.col("id").alias("owner"), "project_id", F.col("qualified_name").alias("up"))
    return m.join(o, ["project_id", "up"]).groupBy("member").agg(F.min("owner").alias("owner"))


def chain_concat(parents: DataFrame, separator: str = ":", depth: int = 32) -> DataFrame:
    """``(node, chain)``: the names along parent pointers ``(node, parent, name)``, outermost first.

    Pointer doubling; a chain ends at a node without a parent, or after ``depth`` links.
    """
    scratch = Scratch(parents.sparkSession, "chains")
    one = parents.groupBy("node").agg(F.min(F.struct("parent", "name")).alias("v")).select("node", F.col("v.parent").alias("ptr"), F.array("v.name").alias("names"))
    state = scratch.write(one)
    jumped = 1
    while jumped < depth:
        seen = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("names").alias("n2"))
        state = scratch.replace(
            state,
            state.join(seen, "ptr", "left").select("node", F.col("p2").alias("ptr"), F.concat(F.coalesce("n2", F.array().cast("array<string>")), "names").alias("names")),
        )
        jumped *= 2
        if state.where(F.col("ptr").isNotNull()).isEmpty():
            break
    scratch.keep(state)
    return state.select("node", F.array_join(F.filter("names", lambda x: x.isNotNull() & (x != "")), separator).alias("chain"))


#: Pairs of a node from which on it is a hub, whose pairs are kept apart and spread evenly.
HUB = 100_000


def restart_walk(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, rounds: int = D.WALK_ROUNDS, damping: float = D.WALK_DAMPING, hub: int = HUB) -> DataFrame:
    """``(id, rank, seed)``: random walk with restart over the undirected multigraph.

    Parallel edges count, a self-loop counts twice; the restart mass is shared by the seeds as
    given (a repeated seed keeps one share); nodes without edges lose their mass. The adjacency
    is reduced to weights per pair once and written in buckets by its source, as many as a shuffle
    has partitions, so that a round shuffles partial sums of ranks and nothing else. The pairs of
    hubs lie apart and meet their few ranks. Ranks are written every fifth round to cut the lineage.
    """
    spark = seeds.sparkSession
    scratch = Scratch(spark, "walk")
    known = nodes.select("id")
    e = edges.select("source", "target").join(known.select(F.col("id").alias("source")), "source", "left_semi").join(known.select(F.col("id").alias("target")), "target", "left_semi")
    both = e.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("x")).select("x.a", "x.b")
    pairs = scratch.write(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")))
    degree = pairs.groupBy("a").agg(F.sum("w").alias("deg"), F.count(F.lit(1)).alias("n"))
    steps = pairs.join(degree, "a").select("a", "b", (F.lit(damping) * F.col("w") / F.col("deg")).alias("share"), (F.col("n") >= hub).alias("hub"))
    given = seeds.select("id")
    n = given.count()
    if n == 0:
        return known.limit(0).select("id", F.lit(0.0).alias("rank"), F.lit(False).alias("seed"))
    with scratch.bucketed(steps.where(~F.col("hub")).select("a", "b", "share"), "a") as near:
        hubs = scratch.write(steps.where("hub").select("a", "b", "share"))
        scratch.drop(pairs)
        crowded = not hubs.isEmpty()
        start = scratch.keep(scratch.write(given.distinct().select("id", F.lit(1.0 / n).alias("rank"))))
        restart = start.select("id", (F.col("rank") * (1.0 - damping)).alias("rank"))
        rank, written = start, None
        for i in range(1, rounds + 1):
            moved = rank.join(near, rank["id"] == near["a"]).select(F.col("b").alias("id"), (F.col("rank") * F.col("share")).alias("rank"))
            if crowded:
                moved = moved.unionByName(hubs.join(rank, rank["id"] == hubs["a"]).select(F.col("b").alias("id"), (F.col("rank") * F.col("share")).alias("rank")))
            rank = moved.unionByName(restart).groupBy("id").agg(F.sum("rank").alias("rank"))
            if i % 5 == 0 or i == rounds:
                rank = scratch.write(rank)
                if written is not None:
                    scratch.drop(written)
                written = rank
        scratch.drop(hubs)
    scratch.keep(rank)
    return rank.where(F.col("rank") > 0).join(start.select("id", F.lit(True).alias("seed")), "id", "left").select("id", "rank", F.coalesce("seed", F.lit(False)).alias("seed"))
