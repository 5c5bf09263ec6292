"""History: commits per path, churn, snapshots, and what changed between revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of history that are ordered in one task at most.
SLICE = 30 * 86_400


def numbered(df: DataFrame, keys: list[str], time: str, order: list, carry: str | None = None, width: int = SLICE) -> DataFrame:
    """``df`` with ``position`` (from 1) in each group's order, and ``before``: the ``carry`` of
    the row before (as a struct, so that a null value differs from no row).

    A group with very many rows is not sorted in one task: rows are ordered within slices of
    time, and the slices' counts and last values (one row per slice) complete them. ``order``
    begins with ``time``.
    """
    s = df.withColumn("_slice", F.coalesce(F.floor(F.col(time) / width), F.lit(-(2**62))).cast("long"))
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    value = F.struct(F.col(carry).alias("v")) if carry else F.struct(F.lit(None).cast("string").alias("v"))
    s = s.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.lag(value).over(w))
    ends = s.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"), F.max_by(value, "_n").alias("_last"))
    v = Window.partitionBy(*keys).orderBy("_slice")
    before = v.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slice").alias("_s2"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.lag("_last").over(v).alias("_prev"))
    match = s["_slice"] == ends["_s2"]
    for k in keys:
        match = match & s[k].eqNullSafe(ends[f"_{k}"])
    out = s.join(ends, match).withColumn("position", (F.col("_n") + F.col("_off")).cast("int"))
    return out.withColumn("before", F.when(F.col("_n") == 1, F.col("_prev")).otherwise(F.col("_b"))).select(*df.columns, "position", "before")


def by_commit(commits: DataFrame, files: DataFrame, like: str) -> DataFrame:
    """Per commit the files under a path pattern (case-insensitive) with their line counts.

    The pattern is applied before the aggregate and reaches the scan of the files.
    """
    hit = files.where(F.col("file_path").ilike(like))
    grouped = hit.groupBy("project_id", "commit_hash").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("insertions"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions")
    )
    return commits.join(grouped, ["project_id", "commit_hash"])


def churn(commits: DataFrame, files: DataFrame, since: int) -> DataFrame:
    """``(project_id, file_path, commits, latest)`` since a time."""
    recent = commits.where(F.col("committed_at") >= since).select("project_id", "commit_hash", "committed_at")
    return files.select("project_id", "commit_hash", "file_path").distinct().join(recent, ["project_id", "commit_hash"]).groupBy("project_id", "file_path").agg(
        F.count(F.lit(1)).alias("commits"), F.max("committed_at").alias("latest")
    )


def changed_since(changes: DataFrame, since: int) -> DataFrame:
    return changes.where(F.col("committed_at") >= since).select("qualified_name").distinct()


def symbol_changes(revisions: DataFrame) -> DataFrame:
    """Revisions as changes of their symbol: added, modified (another signature) or silent.

    Null-safe comparison with the revision before; rows that change nothing are dropped.
    """
    order = ["committed_at", F.col("commit_hash").try_cast("long"), "commit_hash"]
    r = numbered(revisions, ["project_id", "file_path", "qualified_name"], "committed_at", order, "signature")
    kind = F.when(F.col("before").isNull(), "added").when(~F.col("before.v").eqNullSafe(F.col("signature")), "modified")
    r = r.withColumn("change_kind", kind).withColumn("before", F.col("before.v"))
    return r.where(F.col("change_kind").isNotNull()).drop("position")


def diff_revisions(touches: DataFrame, symbols: DataFrame) -> DataFrame:
    """Added, modified and removed symbols per file and revision.

    ``touches(project_id, file_path, commit_hash, committed_at)`` are the revisions of files,
    ``symbols(project_id, file_path, commit_hash, qualified_name, signature)`` what each defines.
    Every symbol is laid against its own revision and, shifted by one, against the next one of
    its file, so one aggregate yields both sides. A removal carries the signature it had.
    """
    # the revision that follows each one: its successor knows it as the one before
    t = numbered(touches.distinct(), ["project_id", "file_path"], "committed_at", ["committed_at", "commit_hash"], "commit_hash")
    after = t.where(F.col("before").isNotNull()).select("project_id", "file_path", F.col("before.v").alias("commit_hash"), F.col("commit_hash").alias("following"))
    t = t.select("project_id", "file_path", "commit_hash").join(after, ["project_id", "file_path", "commit_hash"], "left")
    s = symbols.join(t, ["project_id", "file_path", "commit_hash"])
    now = s.select("project_id", "file_path", "commit_hash", "qualified_name", F.struct("signature").alias("new"), F.lit(None).cast("struct<signature:string>").alias("old"))
    was = s.where(F.col("following").isNotNull()).select(
        "project_id", "file_path", F.col("following").alias("commit_hash"), "qualified_name", F.lit(None).cast("struct<signature:string>").alias("new"), F.struct("signature").alias("old")
    )
    both = now.unionByName(was).groupBy("project_id", "file_path", "commit_hash", "qualified_name").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("new.signature").eqNullSafe(F.col("old.signature")), "modified")
    )
    return both.withColumn("change_kind", kind).where(F.col("change_kind").isNotNull()).select(
        "project_id", "file_path", "commit_hash", "qualified_name", "change_kind", F.coalesce("new.signature", "old.signature").alias("signature")
    )


def as_of(changes: DataFrame, at: int) -> DataFrame:
    """The symbols alive at a time: the latest change of each up to then, unless it removed it.

    An aggregate (``max`` of a struct) instead of a window, so a symbol with a long history is
    reduced before the shuffle.
    """
    keys = ["project_id", "file_path", "qualified_name"]
    rest = [c for c in changes.columns if c not in (*keys, "committed_at", "commit_hash")]
    last = changes.where(F.col("committed_at") <= at).groupBy(*keys).agg(F.max(F.struct("committed_at", "commit_hash", *rest)).alias("v"))
    return last.select(*keys, "v.*").where(F.col("change_kind") != "removed")


def has_revisions(projects: DataFrame, revisions: DataFrame) -> DataFrame:
    """``(id, has_history)`` of ``projects(id)``: whether any symbol revision of it is known."""
    seen = revisions.select(F.col("project_id").alias("id")).distinct().withColumn("has_history", F.lit(True))
    return projects.select("id").join(seen, "id", "left").select("id", F.coalesce("has_history", F.lit(False)).alias("has_history"))


def file_touches(commits: DataFrame, files: DataFrame) -> DataFrame:
    """The revisions of every file in order."""
    t = files.select("project_id", "commit_hash", "file_path").distinct().join(commits.select("project_id", "commit_hash", "committed_at"), ["project_id", "commit_hash"])
    return numbered(t, ["project_id", "file_path"], "committed_at", ["committed_at", "commit_hash"]).withColumnRenamed("position", "revision").drop("before")


def symbol_history(changes: DataFrame, symbol: str) -> DataFrame:
    """The changes of a symbol (whole, or behind ``.`` or ``::``), newest first."""
    q = F.col("qualified_name")
    hit = (q == symbol) | q.endswith("." + symbol) | q.endswith("::" + symbol)
    return changes.where(hit).orderBy(F.desc("committed_at"), F.desc("commit_hash"))
