"""Changes of the index as rewrites: each returns the tables as they stand afterwards.

A store of immutable files has no row updates; a change is an anti-join plus a union, restricted
to the touched projects by partitioned overwrites where a table is partitioned by project. All
of one change is computed from one snapshot and written under one commit of
:class:`symgraph.operators.incremental.VersionedTable`, so it is atomic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove_files(nodes: DataFrame, edges: DataFrame, refs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the files ``gone(project_id, file_path)``: their nodes, all edges that touch
    those, and their pending references."""
    keys = ["project_id", "file_path"]
    dead = nodes.join(gone, keys, "left_semi").select("id")
    e = edges.join(dead.select(F.col("id").alias("source")), "source", "left_anti").join(dead.select(F.col("id").alias("target")), "target", "left_anti")
    return nodes.join(gone, keys, "left_anti"), e, refs.join(gone, keys, "left_anti")


def missing_files(stored: DataFrame, seen: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Stored files that are gone: all that were not ``seen``, or only those of the ``named``
    ones (absence proves deletion only to a full walk)."""
    lost = stored.select("project_id", "path").distinct().join(seen.select("project_id", "path"), ["project_id", "path"], "left_anti")
    return lost if named is None else lost.join(named.select("project_id", "path"), ["project_id", "path"], "left_semi")


def upsert(stored: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows without the changed keys, and the changed rows."""
    return stored.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(changed, allowMissingColumns=True)


def requeue(resolved: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pending again, still resolved)`` when the targets ``dead(id)`` are indexed anew."""
    d = dead.select(F.col("id").alias("target"))
    return resolved.join(d, "target", "left_semi").drop("target", "confidence", "strategy"), resolved.join(d, "target", "left_anti")


def commit_resolved(refs: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(new edges, archive, pending)`` from one decision."""
    hit = refs.join(bound.select("ref_id", "target", "confidence", "strategy"), "ref_id")
    edges = hit.select(F.col("from_node_id").alias("source"), "target", F.col("reference_kind").alias("kind"), "line", "col", F.concat(F.lit("resolution:"), "strategy").alias("provenance"))
    return edges, hit, refs.join(bound.select("ref_id"), "ref_id", "left_anti")


def drop_kind(refs: DataFrame, kind: str) -> DataFrame:
    return refs.where(~F.col("reference_kind").eqNullSafe(F.lit(kind)))


def drop_satisfied(refs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pending references without those an edge already answers: the same source, kind and place,
    or the same source and kind with a target of that name among templates and externals."""
    e = edges.select(F.col("source").alias("from_node_id"), F.col("kind").alias("reference_kind"), "line", "col", "target")
    placed = e.where(F.col("line").isNotNull() & F.col("col").isNotNull()).select("from_node_id", "reference_kind", "line", "col").distinct()
    named = nodes.where(F.col("kind").isin("template", "external")).select(F.col("id").alias("target"), F.col("name").alias("reference_name"))
    by_name = e.join(named, "target").select("from_node_id", "reference_kind", "reference_name").distinct()
    return refs.join(placed, ["from_node_id", "reference_kind", "line", "col"], "left_anti").join(by_name, ["from_node_id", "reference_kind", "reference_name"], "left_anti")


def unify_externals(nodes: DataFrame, edges: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` with edges led from stubs to their definitions, and the stubs gone."""
    e = edges.join(redirects.select(F.col("stub").alias("target"), F.col("target").alias("_to")), "target", "left")
    e = e.withColumn("target", F.coalesce("_to", "target")).drop("_to")
    return nodes.join(redirects.select(F.col("stub").alias("id")), "id", "left_anti"), e


def replace_synthesized(edges: DataFrame, project: str, prefix: str, fresh: DataFrame) -> DataFrame:
    """A project's edges of one synthesis replaced by fresh ones."""
    old = F.coalesce(F.col("provenance").startswith(prefix), F.lit(False)) & F.col("source").startswith(project + "::")
    return edges.where(~old).unionByName(fresh, allowMissingColumns=True)


def replace_project(stored: DataFrame, project: str, fresh: DataFrame) -> DataFrame:
    """Wholesale replacement of one project's rows."""
    return stored.where(~F.col("project_id").eqNullSafe(F.lit(project))).unionByName(fresh, allowMissingColumns=True)


def delete_project(project: str, nodes: DataFrame, edges: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """All tables without a project, edges by the prefix of their ends."""
    own = lambda c: F.startswith(c, F.lit(project + "::"))
    keep = F.col("project_id").isNull() | (F.col("project_id") != project)
    left = edges.where(~(F.coalesce(own("source"), F.lit(False)) | F.coalesce(own("target"), F.lit(False))))
    return [nodes.where(keep), left, *[t.where(keep) for t in tables]]
