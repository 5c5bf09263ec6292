import os

import pytest
from pyspark.sql import functions as F

from symgraph.operators.incremental import VersionedTable, manifest_diff, pending_files, process_new

from .conftest import rows


def test_manifest_diff(spark):
    s = "p string, k string, h string, at bigint, change string"
    old = spark.createDataFrame([("p", "a", "1", 1, ""), ("p", "a", "2", 2, ""), ("p", "b", "1", 1, ""), ("p", "c", None, 1, ""), (None, "d", "1", 1, ""), ("p", "e", "9", None, "")], s)
    new = spark.createDataFrame([("p", "a", "2", 5, ""), ("p", "c", None, 1, ""), ("p", "z", "1", 1, ""), (None, "d", "2", 1, ""), ("p", "e", "9", None, "")], s)
    got = {(r[0], r[1]): r[2] for r in rows(manifest_diff(old, new, ["p", "k"], "at", "at", "h"), "p", "k", "change")}
    assert got == {("p", "a"): "same", ("p", "b"): "removed", ("p", "c"): "same", ("p", "z"): "added", (None, "d"): "changed", ("p", "e"): "same"}
    none = old.limit(0)
    assert rows(manifest_diff(none, none, ["p", "k"], "at", "at", "h")) == []


def tables(spark):
    day = 86_400_000
    runs = spark.createDataFrame([(1, day, 2 * day, "ok", "v1"), (2, 3 * day, 4 * day, "failed", "v1"), (3, 5 * day, None, "killed", "v1"), (4, None, None, "pending", "v1")], "run_id int, started_at bigint, finished_at bigint, status string, index_version string")
    projects = spark.createDataFrame([("p", "v1"), ("q", "v0")], "id string, index_version string")
    files = spark.createDataFrame(
        [("p", "same", "AA", day), ("p", "same", "AA", day), ("p", "new", "AA", day + 5), ("p", "lost", "AA", 3 * day + 1), ("q", "old", "AA", day), ("p", "gone", "AA", day), ("p", "null", None, None)],
        "project_id string, path string, content_hash string, indexed_at bigint",
    )
    scans = spark.createDataFrame(
        [("p", "same", "aa", 9), ("p", "same", "bb", 3), ("p", "new", "bb", 9), ("p", "lost", "aa", 9), ("q", "old", "aa", 9), ("p", "fresh", None, 1), ("x", "foreign", "aa", 1), ("p", "null", "aa", 1)],
        "project_id string, path string, content_hash string, observed_at bigint",
    )
    return files, scans, projects, runs


def test_pending_files(spark):
    files, scans, projects, runs = tables(spark)
    got = {(r[0], r[1]): r[2] for r in rows(pending_files(files, scans, projects, runs))}
    assert got == {("p", "new"): "changed", ("p", "lost"): "added", ("q", "old"): "version", ("p", "fresh"): "added", ("x", "foreign"): "added", ("p", "null"): "added"}
    assert rows(pending_files(files.limit(0), scans.limit(0), projects, runs)) == []
    assert rows(pending_files(files, scans, projects, runs.where("status <> 'pending'"))) == []


def test_versions_deletes_and_diffs(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and t.snapshot() is None and t.diff(0) is None
    one = spark.range(5).withColumn("v", F.lit("a"))
    assert t.commit(add=one) == 1
    hide = t.snapshot(positions=True).where("id in (1, 2)").select("_file", "_row")
    t.commit(add=spark.range(10, 12).withColumn("v", F.lit("b")), delete=hide)
    assert rows(t.snapshot(), "id") == [(0,), (10,), (11,), (3,), (4,)]
    assert rows(t.snapshot(1), "id") == [(i,) for i in range(5)]
    assert rows(t.diff(1, 2), "id", "_delta") == [(1, -1), (10, 1), (11, 1), (2, -1)]
    t.commit(delete=t.snapshot(positions=True).where("id = 3").select("_file", "_row"))
    assert rows(t.diff(2, 3), "id", "_delta") == [(3, -1)]
    assert rows(t.diff(0, 3), "id", "_delta") == [(0, 1), (10, 1), (11, 1), (4, 1)]
    t.commit(add=spark.range(1).withColumn("v", F.lit("c")), replace=True)
    assert rows(t.snapshot()) == [(0, "c")]
    assert rows(t.diff(3, 4), "id", "_delta") == [(0, -1), (0, 1), (10, -1), (11, -1), (4, -1)]


def test_two_writers_of_one_version(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(add=spark.range(1))
    with pytest.raises(Exception):
        t.commit(add=spark.range(2), base=0)
    assert t.version() == 1 and t.snapshot().count() == 1


@pytest.mark.parametrize("step", ["write", "rename"])
def test_a_commit_that_dies_half_way(spark, tmp_path, monkeypatch, step):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(add=spark.range(2))
    if step == "write":  # a manifest that was created and never finished

        def dies(self, body, *parts):
            self.fs.mkdirs(self._at(*parts[:-1]))
            self.fs.create(self._at(*parts[:-1], ".half.tmp"), False).close()
            raise RuntimeError("driver lost")

        monkeypatch.setattr(VersionedTable, "_put", dies)
    else:

        def dies(self, old, new):
            raise RuntimeError("driver lost")

        monkeypatch.setattr(VersionedTable, "_rename", dies)
    with pytest.raises(RuntimeError):
        t.commit(add=spark.range(5))
    monkeypatch.undo()
    assert t.version() == 1 and rows(t.snapshot()) == [(0,), (1,)]
    assert t.commit(add=spark.range(7, 8)) == 2 and rows(t.snapshot()) == [(0,), (1,), (7,)]


def test_merge_rewrites_only_what_changed(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    s = "k string, j string, v string"
    t.merge(spark.createDataFrame([("a", None, "1"), ("b", "x", None), ("c", "x", "1"), ("d", "x", "1")], s), ["k", "j"], "v")
    t.merge(spark.createDataFrame([("a", None, "1"), ("b", "x", "2"), ("c", "x", None), ("e", "x", "1")], s), ["k", "j"], "v")
    assert rows(t.snapshot(), "k", "v") == [("a", "1"), ("b", "2"), ("c", None), ("e", "1")]
    assert rows(t.diff(1, 2), "k", "v", "_delta") == sorted([("b", "2", 1), ("b", None, -1), ("c", "1", -1), ("c", None, 1), ("d", "1", -1), ("e", "1", 1)], key=repr)
    t.merge(spark.createDataFrame([("e", "x", "9")], s), ["k", "j"], "v", full=False)
    assert rows(t.diff(2, 3), "k", "v", "_delta") == [("e", "1", -1), ("e", "9", 1)]
    assert rows(t.diff(1, 3), "k", "_delta") == sorted([("b", 1), ("b", -1), ("c", 1), ("c", -1), ("d", -1), ("e", 1)], key=repr)
    # vectors hold the rows of the files they hide rows of, no others
    hidden = t._vectors(t.files())
    assert hidden.count() == 4 and {f for f, dv in t.files().items() if dv} == {r[0] for r in hidden.select("_file").distinct().collect()}


def test_dropped_files_and_folders(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    df = spark.range(6).withColumn("b", (F.col("id") % 3).cast("int"))
    t.commit(add=df, partition_by=["b"])
    one = [f for f in t.files() if "/b=1/" in f]
    t.commit(add=spark.range(100, 101).withColumn("b", F.lit(1)), drop=one, partition_by=["b"])
    assert rows(t.snapshot()) == [(0,), (100,), (2,), (3,), (5,)]
    assert rows(t.diff(1, 2)) == [(1, -1), (100, 1), (4, -1)]


def test_each_record_once_through_crashes(spark, tmp_path):
    source, sink = (VersionedTable(spark, f"file://{tmp_path}/{n}") for n in ("in", "out"))
    work = lambda df: df.where("_delta = 1").select("id", (F.col("id") * 2).alias("double"))
    source.commit(add=spark.range(3))
    process_new(source, sink, "in", work)
    source.commit(add=spark.range(3, 5))

    def dies(df):
        work(df).write.parquet(f"{tmp_path}/half")  # output that nobody will see
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        process_new(source, sink, "in", dies)
    orphan = f"{tmp_path}/out/data/dead"
    os.makedirs(orphan)  # files of a run that died before its commit
    process_new(source, sink, "in", work)
    assert process_new(source, sink, "in", work) == sink.version()
    assert rows(sink.snapshot()) == [(i, 2 * i) for i in range(5)]
    assert sink.manifest(sink.version())["processed"] == {"in": 2}
