"""Execution flows: entry points, what they reach, and how critical they are.

Entries are classified in one pass; all are traced together (:func:`symgraph.operators.graph.reach`).
A reach set is bounded per flow and marked where it is cut. Measures are one aggregate over the
members. Defined results: a flow that reaches only itself is no flow; ties of names end in the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P
from ..session import Scratch
from .graph import links, reach


def _decorated(words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower("decorators").rlike("|".join(words)), F.lit(False))


def entries(nodes: DataFrame, edges: DataFrame, tests: bool = False) -> DataFrame:
    """``(id, entry_kind)``, the most confident kind of each entry."""
    known = nodes.select("id")
    real = edges.join(known.select(F.col("id").alias("source")), "source", "left_semi")
    into = lambda kinds, flag: real.where(F.col("kind").isin(*kinds)).select(F.col("target").alias("id")).distinct().withColumn(flag, F.lit(True))
    n = nodes.where(~P.is_generated_path("file_path"))
    if not tests:
        n = n.where(~P.is_test_path("file_path"))
    n = n.join(into(D.FLOW_KINDS, "called"), "id", "left").join(into(("receives",), "received"), "id", "left").join(into(("admin_of",), "admin"), "id", "left")
    p = P.forward("file_path")
    kind = (
        F.when(F.col("kind") == "route", "route")
        .when(
            F.col("kind").isin("view", "class", "function") & (_decorated(D.DRF_DECORATORS) | F.coalesce(F.col("signature").rlike("|".join(D.DRF_BASES)), F.lit(False))),
            "drf_view",
        )
        .when(P.is_command_path("file_path") & F.col("name").isin("Command", "handle"), "management_command")
        .when(_decorated(D.TASK_DECORATORS), "celery_task")
        .when(F.col("received") | _decorated(D.RECEIVER_DECORATORS), "signal_receiver")
        .when(F.col("admin"), "admin_action")
        .when((F.col("name") == "ready") & p.endswith("apps.py"), "app_config_hook")
        .when((F.col("kind") == "method") & F.col("name").isin("save", "delete", "clean"), "model_lifecycle")
        .when(F.col("kind").isin("function", "method", "class", "model", "view") & F.col("called").isNull(), "true_root")
    )
    return n.select("id", kind.alias("entry_kind")).where(F.col("entry_kind").isNotNull())


def trace(entry: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = D.FLOW_DEPTH, most: int = D.FLOW_NODES) -> DataFrame:
    """``(flow, node, depth, truncated)``: the members of every flow of at least two.

    A route that a template links to is recorded but not walked on from.
    """
    ids = nodes.select(F.col("id").alias("dst"), (F.col("kind") == "route").alias("to_route"))
    src = nodes.select(F.col("id").alias("src"), (F.col("kind") == "template").alias("from_template"))
    steps = links(edges, D.FLOW_KINDS).join(ids, "dst").join(src, "src")
    # only entries that lead anywhere are traced at all
    start = entry.select(F.col("id").alias("seed"), F.col("id").alias("node")).join(steps.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    found = reach(start, steps, depth, most, F.col("from_template") & F.col("to_route"))
    several = found.where(F.col("depth") > 0).select("seed").distinct()
    return found.join(several, "seed", "left_semi").select(F.col("seed").alias("flow"), "node", "depth", "truncated")


def measure(members: DataFrame, entry: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per flow: shape and criticality."""
    src = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_path"))
    covered = edges.join(src, "source").where(P.is_covering("kind", "source_path")).select(F.col("target").alias("id")).distinct().withColumn("covered", F.lit(True))
    pending = refs.groupBy(F.col("from_node_id").alias("id")).agg(F.count(F.lit(1)).alias("pending"))
    about = (
        nodes.join(covered, "id", "left")
        .join(pending, "id", "left")
        .select(
            F.col("id").alias("node"),
            F.col("project_id").alias("m_project"),
            P.app_segment("file_path").alias("app"),
            F.col("file_path").alias("m_file"),
            (F.when(F.col("kind") == "external", 1).otherwise(0) + F.coalesce("pending", F.lit(0))).alias("leaves"),
            F.when(P.is_sensitive("name", "qualified_name"), 1).otherwise(0).alias("sensitive"),
            F.when(F.col("covered"), 0).otherwise(1).alias("open"),
        )
    )
    home = nodes.select(
        F.col("id").alias("flow"), F.col("project_id").alias("project_id"), P.flow_name("kind", "name", "qualified_name", "file_path").alias("name"), F.col("file_path").alias("entry_path")
    )
    e = entry.select(F.col("id").alias("flow"), "entry_kind")
    rows = members.join(about, "node").join(home.select("flow", "project_id"), "flow")
    shape = rows.groupBy("flow").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.max("depth").alias("depth_max"),
        # sets within one aggregate: a flow is bounded, and distinct counts would multiply its rows
        F.size(F.collect_set("app")).cast("long").alias("apps"),
        F.size(F.collect_set("m_file")).cast("long").alias("files"),
        F.size(F.collect_set(F.when(F.col("m_project") != F.col("project_id"), F.col("m_project")))).cast("long").alias("projects"),
        F.sum("leaves").alias("external"),
        F.avg("sensitive").alias("security"),
        F.avg("open").alias("test_gap"),
        F.max("truncated").alias("truncated"),
    )
    weight = F.create_map(*[F.lit(x) for kv in D.ENTRY_WEIGHTS.items() for x in kv])[F.col("entry_kind")]
    c, sat = D.CRITICALITY, D.CRITICALITY_SATURATION
    score = (
        weight * c["entry"]
        + P.saturating("apps", sat["apps"]) * c["apps"]
        + F.col("security") * c["security"]
        + F.col("test_gap") * c["test_gap"]
        + P.saturating("projects", sat["projects"]) * c["projects"]
        + P.saturating("external", sat["external"]) * c["external"]
        + P.saturating("depth_max", sat["depth"]) * c["depth"]
    )
    return shape.join(e, "flow").join(home, "flow").withColumn("criticality", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def compute(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(flows, members)``, both written once."""
    scratch = Scratch(nodes.sparkSession, "flows")
    entry = scratch.keep(scratch.write(entries(nodes, edges)))
    members = scratch.keep(scratch.write(trace(entry, nodes, edges)))
    return scratch.keep(scratch.write(measure(members, entry, nodes, edges, refs))), members


def retrace(changed: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame, flows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows after files ``changed(project_id, file_path)``, recomputing only what can differ.

    Affected are entries whose old flow touches a changed file, and entries that lead to one in
    the present graph (a reverse walk), so the result equals a full computation.
    """
    touched = nodes.join(changed, ["project_id", "file_path"], "left_semi").select("id")
    entry = entries(nodes, edges)
    back = reach(touched.select(F.lit(0).alias("seed"), F.col("id").alias("node")), links(edges, D.FLOW_KINDS, reverse=True), D.FLOW_DEPTH).select(F.col("node").alias("id"))
    old = members.join(touched.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("flow").alias("id"))
    affected = back.union(old).union(touched).distinct()
    gone = flows.select(F.col("flow").alias("id")).join(entry, "id", "left_anti")
    redo = affected.union(gone).distinct()
    scratch = Scratch(nodes.sparkSession, "retrace")
    again = scratch.keep(scratch.write(entry.join(redo, "id", "left_semi")))
    fresh = scratch.keep(scratch.write(trace(again, nodes, edges)))
    stale = redo.select(F.col("id").alias("flow"))
    new_members = members.join(stale, "flow", "left_anti").unionByName(fresh)
    new_flows = flows.join(stale, "flow", "left_anti").unionByName(measure(fresh, again, nodes, edges, refs).select(*flows.columns))
    return new_flows, new_members


def listing(flows: DataFrame, text: str | None = None, sort: str = "criticality", limit: int = 50) -> DataFrame:
    """The first flows by criticality, name or size, all or those that a text names."""
    if text:
        flows = flows.where(F.lower("name").contains(text.lower()) | F.col("entry_kind").contains(text.lower()))
    order = {"criticality": [F.desc("criticality"), "name"], "name": ["name", F.desc("criticality")], "nodes": [F.desc("nodes"), "name"]}[sort]
    return flows.orderBy(*order, "flow").limit(limit)


def participation(flows: DataFrame, members: DataFrame, top: int = 64) -> DataFrame:
    """``(node, total, most, flow_name)``: summed criticality over each symbol's best flows."""
    m = members.join(flows.select("flow", "name", "criticality"), "flow")
    w = Window.partitionBy("node").orderBy(F.desc("criticality"), "name", "flow")
    best = m.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top)
    return best.groupBy("node").agg(
        F.sum("criticality").alias("total"), F.max("criticality").alias("most"), F.max(F.when(F.col("n") == 1, F.col("name"))).alias("flow_name")
    )


def touching(flows: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """The flows that any of ``ids(node)`` takes part in."""
    return flows.join(members.join(ids.select("node"), "node", "left_semi").select("flow").distinct(), "flow", "left_semi")


def as_records(flows: DataFrame, members: DataFrame) -> DataFrame:
    """Flows with their members as JSON, in the order of depth and id (bounded per flow)."""
    packed = members.groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("node").alias("node_id")))).alias("reach"))
    return flows.join(packed, "flow").withColumn("reach_json", F.to_json("reach")).drop("reach")
