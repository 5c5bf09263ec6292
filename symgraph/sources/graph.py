"""The tables as graph roles: nodes, edges, pending references, files, history.

Labels that no longer parse make a row invisible, not an error. History comes from the order
tables: an order is a commit, its lines are the files it touched, events are symbol revisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain as D
from ..operators.packed import split_packed
from .tables import distinct_edges, latest_nodes, norm_kind, read

NODE_COLUMNS = ("project_id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "docstring", "signature", "decorators", "updated_at")


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The valid nodes in the version that holds (with ``columns``, default all of the role)."""
    want = columns or NODE_COLUMNS
    raw = latest_nodes(read(spark, d, "nodes"), *dict.fromkeys(("kind", *want)))
    return raw.withColumn("kind", norm_kind(F.col("kind"))).where(F.col("kind").isin(*D.NODE_KINDS))


def edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The valid edges, each once; parallel edges under other ids stay."""
    want = columns or ("source", "target", "kind", "line", "col", "provenance")
    raw = distinct_edges(read(spark, d, "edges"), *dict.fromkeys(("kind", *want)))
    return raw.withColumn("kind", norm_kind(F.col("kind"))).where(F.col("kind").isin(*D.EDGE_KINDS))


def refs(spark: SparkSession, d: str) -> DataFrame:
    """Pending references, each once."""
    raw = read(spark, d, "unresolved_refs")
    want = [c for c in raw.columns if c != "ref_id"]
    held = raw.where(F.col("ref_id").isNotNull()).groupBy("ref_id").agg(F.max(F.struct(*want)).alias("v")).select("ref_id", "v.*")
    return held.withColumn("reference_kind", norm_kind(F.col("reference_kind")))


def ref_candidates(spark: SparkSession, d: str) -> DataFrame:
    """``(ref_id, pos, item)`` of the candidates that references carry."""
    return split_packed(refs(spark, d).select("ref_id", "candidates"), "ref_id", "candidates")


def files(spark: SparkSession, d: str) -> DataFrame:
    """One row per (project_id, path): the one written last."""
    raw = read(spark, d, "files")
    want = [c for c in raw.columns if c not in ("project_id", "path", "indexed_at")]
    return raw.groupBy("project_id", "path").agg(F.max(F.struct("indexed_at", *want)).alias("v")).select("project_id", "path", "v.*")


def content(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "file_content").groupBy("project_id", "file_path").agg(F.max("content").alias("content"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "projects").distinct()


def commits(spark: SparkSession, d: str) -> DataFrame:
    """``(project_id, commit_hash, author, committed_at)`` in epoch seconds."""
    o = read(spark, d, "orders")
    return o.select(
        F.lit("shop").alias("project_id"),
        F.col("o_orderkey").cast("string").alias("commit_hash"),
        F.col("o_custkey").cast("string").alias("author"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("committed_at"),
        F.col("o_orderpriority").alias("summary"),
    )


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    """``(project_id, commit_hash, file_path, insertions, deletions)``."""
    li = read(spark, d, "lineitem")
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", F.replace("p_type", F.lit(" "), F.lit("_"))).alias("file_path"))
    return li.join(p, "l_partkey").select(
        F.lit("shop").alias("project_id"),
        F.col("l_orderkey").cast("string").alias("commit_hash"),
        "file_path",
        F.col("l_quantity").cast("long").alias("insertions"),
        F.col("l_linenumber").cast("long").alias("deletions"),
    )


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """``(project_id, file_path, qualified_name, commit_hash, committed_at, signature)``."""
    e = read(spark, d, "events")
    return e.select(
        F.lit("shop").alias("project_id"),
        F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("file_path"),
        F.concat_ws("::", F.col("user_id").cast("string"), "event_type").alias("qualified_name"),
        F.col("event_id").cast("string").alias("commit_hash"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("committed_at"),
        F.get_json_object("props", "$.k").alias("signature"),
    )
