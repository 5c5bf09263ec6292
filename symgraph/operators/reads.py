"""Relational reads over the graph: callers, callees, links, orphans, listings, lookups.

All take DataFrames of the roles in :mod:`symgraph.sources.graph` and are set-oriented: one plan
serves any number of symbols. Rankings with a cap are computed as ``row_number() <= k`` filters,
which Spark applies per partition before the shuffle, so a symbol that a large part of all edges
point at never sorts in one task. Null keys match nothing; ties end in the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P


def related(edges: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """Distinct ``(symbol, kind, other)`` with the multiplicity of parallel edges.

    ``side`` ``source``: callers of each symbol, ``target``: its callees. The edges are reduced
    before they meet the nodes, so parallel edges cross the network once.
    """
    symbol = "target" if side == "source" else "source"
    pairs = edges.groupBy(F.col(symbol).alias("symbol"), "kind", F.col(side).alias("other")).agg(F.count(F.lit(1)).alias("times"))
    about = nodes.select(F.col("id").alias("other"), F.col("project_id").alias("o_project"), F.col("kind").alias("o_kind"), "name", "file_path", "start_line")
    return pairs.join(about, "other")


def ranked(pairs: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each symbol: strongest kind, other projects, definitions, place."""
    home = P.project_of("symbol")
    order = [
        P.edge_rank("kind"),
        F.when(F.col("o_project") == home, 1).otherwise(0),
        P.kind_rank("o_kind"),
        P.path_penalty("file_path"),
        F.col("file_path"),
        F.col("start_line"),
        F.col("other"),
        F.col("kind"),
    ]
    w = Window.partitionBy("symbol").orderBy(*order)
    return pairs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def callers_located(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every non-containing edge with its source's place and the call's line (0 if unknown)."""
    src = nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"), "file_path")
    return edges.where(F.col("kind") != "contains").join(src, "source").withColumn("call_line", F.coalesce("line", F.lit(0)))


def relation_edges(edges: DataFrame) -> DataFrame:
    """``relates_to`` edges that no reverse synthesis made (a null provenance stays)."""
    return edges.where((F.col("kind") == "relates_to") & (F.col("provenance").isNull() | ~F.col("provenance").startswith("synthesis:reverse")))


def members(edges: DataFrame, nodes: DataFrame, owner: tuple[str, ...], member: tuple[str, ...]) -> DataFrame:
    """``(owner, member)`` pairs of containment between kinds."""
    o = nodes.where(F.col("kind").isin(*owner)).select(F.col("id").alias("source"))
    m = nodes.where(F.col("kind").isin(*member)).select(F.col("id").alias("target"), "name", "signature")
    held = edges.where(F.col("kind") == "contains").select("source", "target").distinct()
    return held.join(o, "source").join(m, "target").select(F.col("source").alias("owner"), F.col("target").alias("member"), "name", "signature")


def field_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(owner, member, related)``: the model named by each relation field's declaration."""
    fields = members(edges, nodes, ("class", "model"), ("field",)).withColumn("related", P.relation_target("signature"))
    return fields.where(F.col("related").isNotNull()).select("owner", "member", "related")


def returned_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(callable, type)``: what functions and methods are declared to return."""
    n = nodes.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("source"))
    e = edges.where(F.col("kind") == "returns").join(n, "source", "left_semi")
    return e.select(F.col("source").alias("callable"), F.col("target").alias("type")).distinct()


def identities(nodes: DataFrame) -> DataFrame:
    """``(project_id, file_path, name, what, nodes, first)``: callables and classes by file and name."""
    kinds = F.when(F.col("kind").isin("class", "model"), "class").when(F.col("kind").isin("function", "method"), "callable")
    n = nodes.withColumn("what", kinds).where(F.col("what").isNotNull())
    return n.groupBy("project_id", "file_path", "name", "what").agg(F.count(F.lit(1)).alias("nodes"), F.min("id").alias("first"))


def defined_in_project(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The references whose name a definition of their project has."""
    n = nodes.where(P.is_definition("kind")).select("project_id", F.col("name").alias("reference_name")).distinct()
    return refs.join(n, ["project_id", "reference_name"], "left_semi")


def routes(nodes: DataFrame, edges: DataFrame, refs: DataFrame, pending: str = "routes_to") -> DataFrame:
    """Each route of ``nodes`` with its first handler, that one's first template, the first pending
    reference of the kind ``pending`` where it has no handler, and how often it is reversed."""
    first = lambda kind, a, b: edges.where(F.col("kind") == kind).groupBy(F.col("source").alias(a)).agg(F.min("target").alias(b))
    waits = refs.where(F.col("reference_kind") == pending).groupBy(F.col("from_node_id").alias("route")).agg(F.min("reference_name").alias("unresolved"))
    used = edges.where(F.col("kind") == "resolves").groupBy(F.col("target").alias("route")).agg(F.count(F.lit(1)).alias("reversed"))
    rows = nodes.withColumnRenamed("id", "route").drop("kind").join(first("routes_to", "route", "view"), "route", "left").join(first("renders", "view", "template"), "view", "left")
    rows = rows.join(waits, "route", "left").join(used, "route", "left")
    return rows.withColumn("unresolved", F.when(F.col("view").isNull(), F.col("unresolved"))).withColumn("reversed", F.coalesce("reversed", F.lit(0).cast("long")))


def model_relations(of: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(model, direction, other, name)`` of the models ``of(id)``: what each relates ``to`` and what
    relates to it (``from``), declared relations only, each once."""
    e = relation_edges(edges).where(F.col("source").isNotNull() & F.col("target").isNotNull())
    m = of.select(F.col("id").alias("model")).distinct()
    out = e.select(F.col("source").alias("model"), F.lit("to").alias("direction"), F.col("target").alias("other"))
    back = e.select(F.col("target").alias("model"), F.lit("from").alias("direction"), F.col("source").alias("other"))
    mine = out.unionByName(back).join(m, "model", "left_semi").distinct()
    return mine.join(nodes.select(F.col("id").alias("other"), "name"), "other").select("model", "direction", "other", "name")


def reverse_relations(edges: DataFrame) -> DataFrame:
    """``(source, target)`` to add: relations turned round where no forward one exists."""
    fwd = relation_edges(edges).where(F.col("source") != F.col("target"))
    fwd = fwd.where(P.project_of("source") == P.project_of("target")).select("source", "target").distinct()
    turned = fwd.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return turned.join(fwd, ["source", "target"], "left_anti")


def cross_project(edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in different projects (by the prefix of their ids)."""
    s, t = P.project_of("source"), P.project_of("target")
    return edges.withColumn("from_project", s).withColumn("to_project", t).where(s != t)


def link_pairs(edges: DataFrame) -> DataFrame:
    return cross_project(edges).groupBy("from_project", "to_project").agg(F.count(F.lit(1)).alias("links"))


def link_page(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The newest linked edges with the names at both ends."""
    s = nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    t = nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    made = edges.where(F.col("provenance").startswith("link:"))
    return made.join(s, "source").join(t, "target").orderBy(F.desc("edge_id")).limit(limit)


def orphans(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Definitions that nothing but containment points at, that no framework reaches, and whose
    name no pending reference of their project mentions."""
    pointed = edges.where(F.col("kind") != "contains").select(F.col("target").alias("id")).distinct()
    dark = refs.where(~F.col("reference_kind").isin(*D.PIPELINE_KINDS)).select("project_id", F.col("reference_name").alias("name")).distinct()
    plain = nodes.where(P.is_definition("kind") & ~P.is_framework_reached("name", "file_path"))
    return plain.join(pointed, "id", "left_anti").join(dark, ["project_id", "name"], "left_anti")


def innermost(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each ``(point_id, project_id, file_path, at)`` the smallest node around its line.

    A stabbing join: equal file first, then the range; the best match is an aggregate, so no
    point's candidates are sorted.
    """
    span = nodes.where(F.col("start_line").isNotNull() & F.col("end_line").isNotNull() & ~F.col("kind").isin("file", "module", "import")).select(
        "project_id", "file_path", "start_line", "end_line", F.col("id").alias("node_id")
    )
    hit = points.join(span, ["project_id", "file_path"]).where(F.col("at").between(F.col("start_line"), F.col("end_line")))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), F.col("node_id"))).alias("b")
    return hit.groupBy("point_id").agg(best).select("point_id", F.col("b.node_id").alias("node_id"), F.col("b.size").alias("size"))


def touched(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, lines)``: symbols that changed ranges overlap, with the changed lines.

    ``hunks(project_id, file_path, h_start, h_end)``; lines saturate at the symbol's span.
    """
    kinds = ("class", "function", "method", "model", "view")
    n = nodes.where(F.col("kind").isin(*kinds)).select("id", "project_id", "file_path", "start_line", "end_line")
    j = hunks.join(n, ["project_id", "file_path"]).where((F.col("start_line") <= F.col("h_end")) & (F.col("end_line") >= F.col("h_start")))
    shared = P.overlap(F.col("start_line"), F.col("end_line"), F.col("h_start"), F.col("h_end"))
    total = j.groupBy(F.col("id").alias("node_id"), "start_line", "end_line").agg(F.sum(shared).alias("s"))
    return total.select("node_id", F.least(F.col("s"), (F.col("end_line") - F.col("start_line") + 1).cast("long")).alias("lines"))


def seeds(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(symbol, id, way)``: what each asked ``symbol`` may mean, by the first way that answers.

    Ways: 1 exact qualified name (with ``::``), 2 ``Owner.member`` at a name boundary, 3 exact
    name, 4 last path segment.
    """
    s = names.select("symbol").where(F.col("symbol").isNotNull()).distinct()
    n = nodes.select("id", "name", "qualified_name")
    exact = s.where(F.col("symbol").contains("::")).join(n, F.col("symbol") == F.col("qualified_name")).select("symbol", "id", F.lit(1).alias("way"))
    dotted = s.where(F.col("symbol").contains(".") & ~F.col("symbol").contains("::")).withColumn("last", F.substring_index("symbol", ".", -1))
    q = F.col("qualified_name")
    tail = (q == F.col("symbol")) | F.endswith(q, F.concat(F.lit("."), F.col("symbol"))) | F.endswith(q, F.concat(F.lit("::"), F.col("symbol")))
    member = dotted.join(n, F.col("last") == F.col("name")).where(tail).select("symbol", "id", F.lit(2).alias("way"))
    named = s.join(n, F.col("symbol") == F.col("name")).select("symbol", "id", F.lit(3).alias("way"))
    slashed = s.join(n.where(F.col("name").contains("/")), F.col("symbol") == F.substring_index("name", "/", -1)).select("symbol", "id", F.lit(4).alias("way"))
    every = exact.unionByName(member).unionByName(named).unionByName(slashed)
    first = every.groupBy("symbol").agg(F.min("way").alias("way"))
    return every.join(first, ["symbol", "way"]).select("symbol", "id", "way").distinct()


def event_links(dispatch: DataFrame, listen: DataFrame, most: int = 64) -> DataFrame:
    """``(source, target)`` of dispatchers and listeners of one event.

    The sizes of both sides are counted per event first, and events whose product exceeds
    ``most`` are left out before any pair exists, so no group explodes.
    """
    d = dispatch.select("event", F.col("id").alias("source")).distinct()
    li = listen.select("event", F.col("id").alias("target")).distinct()
    sizes = d.groupBy("event").agg(F.count(F.lit(1)).alias("nd")).join(li.groupBy("event").agg(F.count(F.lit(1)).alias("nl")), "event")
    small = sizes.where(F.col("nd") * F.col("nl") <= most).select("event")
    return d.join(small, "event").join(li, "event").where(F.col("source") != F.col("target")).select("source", "target").distinct()


def template_overrides(nodes: DataFrame) -> DataFrame:
    """``(source, target)`` from each project's template to the canonical one of the same name.

    The name is the path behind the last ``templates/``; the owner is the project that the
    name's first segment names, else the first project. One aggregate and one join, no pairs.
    """
    t = nodes.where(F.col("kind") == "template").select("id", "project_id", F.regexp_replace(P.forward("file_path"), r"^.*templates/", "").alias("template"))
    mine = F.when(F.split("template", "/")[0] == F.col("project_id"), 0).otherwise(1)
    owner = t.groupBy("template").agg(F.min(F.struct(mine.alias("rank"), "project_id", "id")).alias("o"), F.count_distinct("project_id").alias("n")).where(F.col("n") > 1)
    owner = owner.select("template", F.col("o.id").alias("target"), F.col("o.project_id").alias("owner"))
    return t.join(owner, "template").where(F.col("project_id") != F.col("owner")).select(F.col("id").alias("source"), "target")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A window of a totally ordered listing."""
    return df.orderBy(*order).offset(offset).limit(limit)
