"""Processing only new or changed records, and surviving failures without loss or repeat.

Two levels share one idea, the diff of immutable manifests.

* :func:`manifest_diff` compares two manifests held as tables (one row per key with the hash
  of its content): added, changed and removed keys. Both sides are reduced in one map-side
  combined aggregate over their union, so a manifest is read once and shuffled once, however
  many observations a key has.
* :class:`VersionedTable` is a table of immutable Parquet files whose versions are manifests
  (JSON: lists of data files with their deletion vectors, versions processed). ``diff`` reads
  only the lists that one manifest has and the other has not, of them the files that differ, and
  the rows whose deletion vectors differ. ``merge`` makes a version out of a new state.
  :func:`process_new` applies a function to the delta and commits its output *and* the source
  version it has processed in one manifest. A manifest is written under a hidden name and renamed,
  which is the commit: a run that dies before leaves nothing visible, a run after it starts
  behind that version.

:func:`pending_files` is both together: the state that successful runs indexed is one version, the
state that the walk saw is merged as the next, and the delta between them is what the pending run
must process; it is committed with the version it was computed from.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import Scratch, filesystem


def manifest_diff(old: DataFrame, new: DataFrame, keys: list[str], old_at: str, new_at: str, value: str) -> DataFrame:
    """``(keys, old_value, new_value, in_old, in_new, change)`` between two manifests.

    Of several rows of a key the one with the greatest ``old_at``/``new_at`` holds (ties: the
    greatest value). ``change`` is added, removed, changed or same; values compare null-safe.
    Rows with a null key part are kept as a key of their own.
    """
    side = lambda df, at, flag: df.select(
        *keys, F.lit(flag).alias("_new"), F.struct(F.coalesce(F.col(at), F.lit(-(2**63))).alias("at"), F.col(value).alias("v")).alias("_s")
    )
    both = side(old, old_at, False).unionByName(side(new, new_at, True))
    agg = both.groupBy(*keys).agg(
        F.max(F.when(~F.col("_new"), F.col("_s"))).alias("_o"),
        F.max(F.when(F.col("_new"), F.col("_s"))).alias("_n"),
    )
    return agg.select(
        *keys,
        F.col("_o.v").alias("old_value"),
        F.col("_n.v").alias("new_value"),
        F.col("_o").isNotNull().alias("in_old"),
        F.col("_n").isNotNull().alias("in_new"),
        F.when(F.col("_o").isNull(), "added")
        .when(F.col("_n").isNull(), "removed")
        .when(~F.col("_o.v").eqNullSafe(F.col("_n.v")), "changed")
        .otherwise("same")
        .alias("change"),
    )


def written_during(files: DataFrame, runs: DataFrame, at: str, status: str = "ok") -> DataFrame:
    """The rows of ``files`` whose time ``at`` lies in a finished run of the given status.

    An interval join by day: runs are listed under each day they touch, files join on their
    day. Runs do not overlap, so a row matches once. Unfinished runs have no interval.
    """
    day = 86_400_000
    spans = (
        runs.where((F.col("status") == status) & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull())
        .select("started_at", "finished_at")
        .distinct()
        .select(
            "started_at",
            "finished_at",
            F.explode(F.sequence(F.floor(F.col("started_at") / day).cast("long"), F.floor(F.col("finished_at") / day).cast("long"))).alias("_day"),
        )
    )
    f = files.withColumn("_day", F.floor(F.col(at) / day).cast("long"))
    inside = (f["_day"] == spans["_day"]) & f[at].between(spans["started_at"], spans["finished_at"])
    return f.join(spans, inside, "left_semi").drop("_day")


def pending_files(files: DataFrame, scans: DataFrame, projects: DataFrame, runs: DataFrame) -> DataFrame:
    """``(project_id, path, change)`` of the files that the pending run must process.

    ``change`` is added (no indexed state from a successful run), changed (another hash, letter
    case aside) or version (only the project's ``index_version`` isn't that of the pending run).
    Without a pending run nothing is pending; a project that is not listed has no version.

    A file's state is its hash with the indexer's version. The states that successful runs left
    are version 1 of a table, those that the pending run is to reach are merged as version 2, and
    :func:`process_new` turns the delta into the output.
    """
    spark = files.sparkSession
    keys = ["project_id", "path"]
    # one row, the pending run's version: a scalar, not a join of two tables
    wanted = runs.where(F.col("status") == "pending").select(F.max("index_version").alias("v")).first()["v"]
    scratch = Scratch(spark, "pending")
    source, sink = VersionedTable(spark, scratch.folder("state")), VersionedTable(spark, scratch.folder("pending"))
    state = lambda df, at: df.groupBy(*keys).agg(F.max(F.struct(F.coalesce(F.col(at), F.lit(-(2**63))).alias("at"), F.lower("content_hash").alias("h"))).alias("_s"))
    has = projects.groupBy(F.col("id").alias("project_id")).agg(F.max("index_version").alias("version"))
    indexed = state(written_during(files, runs, "indexed_at"), "indexed_at").join(has, "project_id", "left")
    source.commit(add=indexed.select(*keys, F.struct(F.col("_s.h").alias("h"), "version").alias("state")), processed={"runs": 0})
    sink.commit(processed={"state": source.version()})
    if wanted is not None:
        seen = state(scans, "observed_at")
        source.merge(seen.select(*keys, F.struct(F.col("_s.h").alias("h"), F.lit(wanted).alias("version")).alias("state")), keys, "state")
    process_new(source, sink, "state", _changes)
    out = sink.snapshot()
    return spark.createDataFrame([], "project_id string, path string, change string") if out is None else out


def _changes(delta: DataFrame) -> DataFrame:
    """The keys that are there after a delta, with what changed. Only the delta is shuffled."""
    side = lambda sign: F.max(F.when(F.col("_delta") == sign, F.struct("state")))
    both = delta.groupBy("project_id", "path").agg(side(-1).alias("_o"), side(1).alias("_n")).where(F.col("_n").isNotNull())
    other = ~F.col("_o.state.h").eqNullSafe(F.col("_n.state.h"))
    return both.select("project_id", "path", F.when(F.col("_o").isNull(), "added").when(other, "changed").otherwise("version").alias("change"))


class VersionedTable:
    """Immutable Parquet files under ``path/data`` and one JSON manifest per version.

    A manifest names its lists of files; a commit adds a list and rewrites only those whose files
    it drops or hides rows of, so a commit to a large table is as small as its change. Row
    positions in deletion vectors are those of Parquet's row index; a file's vector only grows.
    Manifests never change: of two writers of one version the second fails and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self._cls = filesystem(spark, path)

    def _at(self, *parts: str):
        return self._cls("/".join([self.path, *parts]))

    def _get(self, *parts: str) -> dict:
        stream = self.fs.open(self._at(*parts))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _put(self, body: dict, *parts: str) -> None:
        """Written under a hidden name, closed, then renamed to a name that must not exist."""
        final = self._at(*parts)
        hidden = self._at(*parts[:-1], f".{uuid.uuid4().hex}.tmp")
        self.fs.mkdirs(final.getParent())
        stream = self.fs.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps(body).encode()))
        finally:
            stream.close()
        try:
            self._rename(hidden, final)
        except Exception:
            self.fs.delete(hidden, False)
            raise

    def _rename(self, old, new) -> None:
        """A rename that fails where ``new`` exists (``FileSystem.rename`` may replace it)."""
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(old), self.fs.makeQualified(new), options)

    def version(self) -> int:
        """The latest version; 0 for an empty table. Hidden names are of commits under way or dead."""
        folder = self._at("manifests")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")])

    def manifest(self, version: int) -> dict:
        if version <= 0:
            return {"version": 0, "lists": [], "processed": {}, "schema": None}
        return self._get("manifests", f"{version:020d}.json")

    def _files(self, lists: list[str]) -> dict[str, str | None]:
        """The data files of some lists, each with its deletion vector."""
        return {f: dv for name in lists for f, dv in self._get("lists", f"{name}.json").items()}

    def files(self, version: int | None = None) -> dict[str, str | None]:
        return self._files(self.manifest(self.version() if version is None else version)["lists"])

    def _names(self, folder: str) -> list[str]:
        """The Parquet files under a folder, in partition folders too, relative to the table."""
        found, todo = [], [folder]
        while todo:
            at = todo.pop()
            for s in self.fs.listStatus(self._at(at)):
                name = s.getPath().getName()
                if s.isDirectory():
                    todo.append(f"{at}/{name}")
                elif name.endswith(".parquet"):
                    found.append(f"{at}/{name}")
        return found

    def commit(
        self,
        add: DataFrame | None = None,
        delete: DataFrame | None = None,
        processed: dict[str, int] | None = None,
        base: int | None = None,
        replace: bool = False,
        drop: list[str] | None = None,
        partition_by: list[str] | None = None,
    ) -> int:
        """Write ``add``, hide the rows in ``delete(_file, _row)`` and create the next version.

        ``base``: the version the change was computed from (default the latest). ``drop``: data
        files that the version no longer has. ``partition_by``: columns that name ``add``'s folders.
        """
        base = self.version() if base is None else base
        old = self.manifest(base)
        lists: list[str] = [] if replace else list(old["lists"])
        tag = uuid.uuid4().hex
        schema = old["schema"]
        changed: dict[str, str | None] = {}
        gone = set(drop or ())
        if delete is not None and not replace:
            touched = {r[0] for r in delete.select("_file").distinct().toLocalIterator()}  # names of files, not rows
            held = self._files(lists)
            touched &= set(held)
            if touched:
                hidden = delete.select("_file", "_row")
                before = self._vectors({f: held[f] for f in touched})
                if before is not None:  # the vectors of the touched files, and of no others, are written again
                    hidden = hidden.unionByName(before.join(delete.select("_file").distinct(), "_file", "left_semi")).distinct()
                hidden.repartition("_file").sortWithinPartitions("_file", "_row").write.parquet(f"{self.path}/dv/{tag}")
                changed = {f: f"dv/{tag}" for f in touched}
        if changed or gone:
            kept, moved = [], {}
            for name in lists:
                own = self._files([name])
                if own.keys().isdisjoint(changed) and own.keys().isdisjoint(gone):
                    kept.append(name)
                else:
                    moved |= {f: changed.get(f, dv) for f, dv in own.items() if f not in gone}
            lists = kept
            if moved:
                self._put(moved, "lists", f"{tag}-moved.json")
                lists.append(f"{tag}-moved")
        if add is not None:
            writer = add.write
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(f"{self.path}/data/{tag}")
            self._put({f: None for f in self._names(f"data/{tag}")}, "lists", f"{tag}.json")
            lists.append(tag)
            stored = add.drop(*(partition_by or []))
            if schema is None or replace:
                schema = stored.schema.jsonValue()
            else:
                known = {f["name"] for f in schema["fields"]}
                schema = schema | {"fields": schema["fields"] + [f for f in stored.schema.jsonValue()["fields"] if f["name"] not in known]}
        body = {"version": base + 1, "lists": lists, "processed": {**old["processed"], **(processed or {})}, "schema": schema}
        self._put(body, "manifests", f"{base + 1:020d}.json")
        return base + 1

    def merge(self, rows: DataFrame, keys: list[str], value: str, full: bool = True, processed: dict[str, int] | None = None) -> int:
        """The next version, in which the table's state is ``rows(keys, value)``, a row per key.

        Rows whose value stays are not touched: they stay in their files. Others are hidden by
        deletion vectors and written anew. ``full``: keys that ``rows`` has not are removed. Both
        states meet in one aggregate, so that each is shuffled once; values compare null-safe.
        """
        base = self.version()
        stored = self.snapshot(base, positions=True)
        if stored is None:
            return self.commit(add=rows.select(*keys, value), processed=processed, base=base)
        scratch = Scratch(self.spark, "merge")
        if not full:  # only the stored rows of these keys meet them; a small change is broadcast by its measured size
            rows = scratch.keep(scratch.write(rows.select(*keys, value)))
            named = rows.select(*[F.col(k).alias(f"_{k}") for k in keys])
            stored = stored.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
        old = stored.select(*keys, F.struct("_file", "_row", F.col(value).alias("v")).alias("_o"))
        new = rows.select(*keys, F.struct(F.col(value).alias("v")).alias("_n"))
        both = old.unionByName(new, allowMissingColumns=True).groupBy(*keys).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"))
        moved = both.where(~F.col("_o.v").eqNullSafe(F.col("_n.v")) | F.col("_o").isNull() | F.col("_n").isNull())
        if not full:
            moved = moved.where(F.col("_n").isNotNull())
        moved = scratch.write(moved)
        try:
            delete = moved.where(F.col("_o").isNotNull()).select("_o._file", "_o._row")
            add = moved.where(F.col("_n").isNotNull()).select(*keys, F.col("_n.v").alias(value))
            return self.commit(add=add, delete=delete, processed=processed, base=base)
        finally:
            scratch.drop(moved)

    def _vectors(self, files: dict[str, str | None]) -> DataFrame | None:
        """The hidden ``(_file, _row)`` of ``files``, and what was written beside them."""
        used = sorted({dv for dv in files.values() if dv})
        if not used:
            return None
        return self.spark.read.schema("_file string, _row bigint").parquet(*[f"{self.path}/{v}" for v in used]).distinct()

    def _rows(self, names: list[str], schema: dict) -> DataFrame | None:
        if not names:
            return None
        df = self.spark.read.schema(StructType.fromJson(schema)).parquet(*[f"{self.path}/{n}" for n in sorted(names)])
        rel = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]{32}/.+)$", 1)
        return df.select("*", rel.alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def read(self, names: list[str], version: int | None = None) -> DataFrame | None:
        """The rows of some data files of a version."""
        m = self.manifest(self.version() if version is None else version)
        held = self._files(m["lists"])
        rows = self._visible({f: held[f] for f in names}, m["schema"])
        return rows if rows is None else rows.drop("_file", "_row")

    def _visible(self, files: dict[str, str | None], schema: dict) -> DataFrame | None:
        """The rows of ``files`` that their vectors don't hide, with positions.

        Files without a vector are read as they are; only the others meet their vectors.
        """
        plain = self._rows([f for f, dv in files.items() if not dv], schema)
        pocked = {f: dv for f, dv in files.items() if dv}
        if not pocked:
            return plain
        rows = self._rows(list(pocked), schema).join(self._vectors(pocked), ["_file", "_row"], "left_anti")
        return rows if plain is None else plain.unionByName(rows)

    def snapshot(self, version: int | None = None, positions: bool = False) -> DataFrame | None:
        """The rows of a version, with ``_file`` and ``_row`` if asked; None if it has no file."""
        m = self.manifest(self.version() if version is None else version)
        rows = self._visible(self._files(m["lists"]), m["schema"])
        return rows if positions or rows is None else rows.drop("_file", "_row")

    def diff(self, since: int, until: int | None = None) -> DataFrame | None:
        """Rows with ``_delta`` +1 (added) or -1 (removed) between two versions.

        Lists that both manifests have are not read, nor are files in both under the same
        deletion vector. None: no change.
        """
        a, b = self.manifest(since), self.manifest(self.version() if until is None else until)
        was = self._files([x for x in a["lists"] if x not in set(b["lists"])])
        now = self._files([x for x in b["lists"] if x not in set(a["lists"])])
        moved = [f for f in now if f in was and was[f] != now[f]]
        out: list[DataFrame] = []
        for files, other, m, delta in ((now, was, b, 1), (was, now, a, -1)):
            rows = self._visible({f: dv for f, dv in files.items() if f not in other}, m["schema"]) if files else None
            if rows is not None:
                out.append(rows.drop("_file", "_row").withColumn("_delta", F.lit(delta)))
        if moved:
            before, after = self._vectors({f: was[f] for f in moved}), self._vectors({f: now[f] for f in moved})
            fresh = after if before is None else after.join(before, ["_file", "_row"], "left_anti")
            rows = self._rows(moved, b["schema"]).join(fresh, ["_file", "_row"], "left_semi")
            out.append(rows.drop("_file", "_row").withColumn("_delta", F.lit(-1)))
        if not out:
            return None
        total = out[0]
        for x in out[1:]:
            total = total.unionByName(x, allowMissingColumns=True)
        return total


def process_new(source: VersionedTable, sink: VersionedTable, name: str, fn: Callable[[DataFrame], DataFrame]) -> int:
    """Apply ``fn`` to what changed in ``source`` since ``sink`` last processed it.

    Returns the sink's version. The output and the processed version are one commit, so a crash
    at any point neither skips nor repeats a record; without news nothing is committed.
    """
    base = sink.version()
    done = int(sink.manifest(base)["processed"].get(name, 0))
    until = source.version()
    if until == done:
        return base
    delta = source.diff(done, until)
    return sink.commit(add=fn(delta) if delta is not None else None, processed={name: until}, base=base)
