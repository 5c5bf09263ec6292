"""Queries of the general data problems: p3 (incremental), p4 (hierarchies), p5 (packed fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators.incremental import pending_files
from ..operators.packed import split_packed
from ..sources.tables import latest_nodes, norm_kind, read
from .registry import Registry

registry = Registry()

_P3 = """
WITH cur AS (
  SELECT project_id, path, lower(content_hash) AS h FROM file_scan
  QUALIFY row_number() OVER (PARTITION BY project_id, path ORDER BY observed_at DESC, lower(content_hash) DESC NULLS LAST) = 1),
idx AS (
  SELECT f.project_id, f.path, lower(f.content_hash) AS h FROM files f
  JOIN index_runs r ON r.status = 'ok' AND f.indexed_at BETWEEN r.started_at AND r.finished_at
  QUALIFY row_number() OVER (PARTITION BY f.project_id, f.path ORDER BY f.indexed_at DESC, lower(f.content_hash) DESC NULLS LAST) = 1),
want AS (SELECT max(index_version) AS v FROM index_runs WHERE status = 'pending')
SELECT {columns}
FROM cur LEFT JOIN (SELECT *, true AS there FROM idx) idx USING (project_id, path)
LEFT JOIN (SELECT id, max(index_version) AS has FROM projects GROUP BY id) p ON p.id = cur.project_id, want
WHERE there IS NULL OR cur.h IS DISTINCT FROM idx.h OR has IS DISTINCT FROM want.v
"""


def _p3(spark: SparkSession, d: str) -> DataFrame:
    return pending_files(read(spark, d, "files"), read(spark, d, "file_scan"), read(spark, d, "projects"), read(spark, d, "index_runs"))


@registry.query("p3_found", _P3.format(columns="cur.project_id, cur.path"))
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).select("project_id", "path")


@registry.query(
    "p3_changes",
    _P3.format(columns="cur.project_id, cur.path, CASE WHEN there IS NULL THEN 'added' WHEN cur.h IS DISTINCT FROM idx.h THEN 'changed' ELSE 'version' END AS change"),
)
def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, with the reason."""
    return _p3(spark, d)


def hierarchy_links(spark: SparkSession, d: str) -> DataFrame:
    """``contains`` (source is the parent) and ``extends_template`` (target is the parent)."""
    e = read(spark, d, "edges").select(norm_kind(F.col("kind")).alias("hierarchy"), "source", "target")
    down = F.col("hierarchy") == "contains"
    return e.where(F.col("hierarchy").isin("contains", "extends_template")).select(
        "hierarchy",
        F.when(down, F.col("source")).otherwise(F.col("target")).alias("parent"),
        F.when(down, F.col("target")).otherwise(F.col("source")).alias("child"),
    )


_LINKS = """
links AS (
  SELECT h AS hierarchy, CASE h WHEN 'contains' THEN source ELSE target END AS parent, CASE h WHEN 'contains' THEN target ELSE source END AS child
  FROM (SELECT DISTINCT lower(trim(kind)) AS h, source, target FROM edges WHERE lower(trim(kind)) IN ('contains', 'extends_template'))),
up AS (SELECT hierarchy, child AS node, min(parent) AS up FROM links GROUP BY ALL),
ids AS (SELECT hierarchy, parent AS node FROM links UNION SELECT hierarchy, child FROM links)
"""

_P4 = f"""
WITH RECURSIVE {_LINKS},
walk(hierarchy, node, top, depth, trail) AS (
  SELECT hierarchy, node, node, 0, [node] FROM ids
  UNION ALL
  SELECT w.hierarchy, w.node, u.up, w.depth + 1, list_append(w.trail, u.up) FROM walk w JOIN up u ON u.hierarchy = w.hierarchy AND u.node = w.top
  WHERE NOT list_contains(w.trail[:-2], w.top)),
last AS (SELECT *, list_contains(trail[:-2], top) AS ring FROM walk QUALIFY row_number() OVER (PARTITION BY hierarchy, node ORDER BY depth DESC) = 1)
"""


@registry.query(
    "p4_found",
    _P4
    + """SELECT hierarchy, node AS node_id, CASE WHEN ring THEN list_min(trail[list_position(trail, top):]) ELSE top END AS root_id,
  CAST(CASE WHEN ring THEN -1 ELSE depth END AS INTEGER) AS depth FROM last""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return H.resolve(hierarchy_links(spark, d)).select("hierarchy", F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


@registry.query(
    "p4_paths",
    _P4
    + """SELECT hierarchy, node AS node_id, top AS root_id, CAST(depth AS INTEGER) AS depth, array_to_string(list_reverse(trail), ' > ') AS path FROM last WHERE NOT ring""",
)
def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    p = H.paths(hierarchy_links(spark, d))
    return p.select("hierarchy", F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path")


@registry.query(
    "p4_descendants",
    _P4
    + """SELECT w.hierarchy, w.top AS ancestor_id, w.node AS node_id, CAST(w.depth AS INTEGER) AS distance
  FROM walk w JOIN last l USING (hierarchy, node) WHERE NOT l.ring AND w.depth > 0""",
)
def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    p = H.descendants(hierarchy_links(spark, d))
    return p.select("hierarchy", F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), F.col("distance").cast("int").alias("distance"))


@registry.query("p4_all_descendants")
def p4_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """As p4_descendants, with the nodes on and below rings, whom its SQL leaves out. Checked by brute force in the tests."""
    p = H.all_descendants(hierarchy_links(spark, d))
    return p.select("hierarchy", F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), F.col("distance").cast("int").alias("distance"))


@registry.query(
    "p4_cycles",
    _P4
    + """SELECT hierarchy, list_min(trail[list_position(trail, top):]) AS cycle_id, count(*) AS nodes FROM last WHERE ring GROUP BY ALL""",
)
def p4_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Each ring by its smallest id, with the nodes on and below it."""
    r = H.resolve(hierarchy_links(spark, d)).where("cyclic")
    return r.groupBy("hierarchy", F.col("root").alias("cycle_id")).agg(F.count(F.lit(1)).alias("nodes"))


def decorator_items(spark: SparkSession, d: str) -> DataFrame:
    """``(id, pos, item)`` of the version of each node that holds."""
    nodes = read(spark, d, "nodes")
    return split_packed(latest_nodes(nodes, "decorators"), "id", "decorators", at_sign=True, source=nodes)


@registry.query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: quotes and brackets nest. Checked by round trips and a character-wise parser in the tests."""
    given = read(spark, d, "unresolved_refs")
    refs = given.where(F.col("ref_id").isNotNull()).groupBy("ref_id").agg(F.max("candidates").alias("candidates"))
    both = [
        decorator_items(spark, d).select(F.lit("decorators").alias("field"), F.col("id").alias("record_id"), "pos", "item"),
        split_packed(refs, "ref_id", "candidates", source=given).select(F.lit("candidates").alias("field"), F.col("ref_id").cast("string").alias("record_id"), "pos", "item"),
    ]
    return both[0].unionByName(both[1])
