"""Session defaults and tables written to the shared checkpoint folder.

Iterative operators cut their lineage by writing a Parquet table into the folder that the
session names in ``spark.checkpoint.dir``. A written table outlives lost executors, gives the
next plan true sizes (so that adaptive execution picks joins by measurement) and costs one
write. Where the setting is empty, a temporary folder is used on a local master only; on a
cluster an unset folder is an error, for a machine-local path would not be shared.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Tables by application that results still read.
_KEPT: dict[str, list[str]] = {}


def get_spark(app: str = "symgraph", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (a cluster brings its own)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SYMGRAPH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = _LOCAL[app] = tempfile.mkdtemp(prefix="symgraph-")
        atexit.register(lambda: __import__("shutil").rmtree(folder, ignore_errors=True))
    return "file://" + _LOCAL[app]


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and its JVM ``Path`` class."""
    jvm = spark._jvm
    cls = jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark._jsc.hadoopConfiguration()), cls


def remove(spark: SparkSession, path: str) -> None:
    fs, cls = filesystem(spark, path)
    fs.delete(cls(path), True)


#: Files of a table up to which the driver reads their footers instead of starting a job.
_FOOTERS = 32


def release(spark: SparkSession) -> int:
    """Free the tables kept for results so far, once those are consumed; how many there were.

    For long sessions and streams: a result whose plan still reads such a table is void afterwards.
    """
    paths = _KEPT.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            release(spark)
    except Exception:  # the session is gone, and on a local master its folder with it
        pass


class Scratch:
    """Tables written under the shared folder, each dropped when its successor stands.

    >>> with Scratch(spark) as scratch:
    ...     state = scratch.write(first)
    ...     state = scratch.replace(state, step(state))

    ``keep`` hands the final table to the caller: it stays until :func:`release` or the end of
    the session, because the caller's lazy plan still reads it.
    """

    def __init__(self, spark: SparkSession, name: str = "scratch") -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/symgraph-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self._sized: dict[int, str] = {}  # of kept tables
        self._alive: dict[int, DataFrame] = {}
        self.step = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.step += 1
        path = f"{self.root}/{self.step}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._alive[id(out)] = out
        return out

    def size(self, df: DataFrame) -> int:
        """The bytes of a written table."""
        path = self.paths.get(id(df)) or self._sized[id(df)]
        fs, cls = filesystem(self.spark, path)
        return fs.getContentSummary(cls(path)).getLength()

    def rows(self, df: DataFrame) -> int:
        """How many rows a written table has: from the footers of a few files, else by a job."""
        path = self.paths.get(id(df)) or self._sized[id(df)]
        fs, cls = filesystem(self.spark, path)
        files = [s for s in fs.listStatus(cls(path)) if s.getPath().getName().endswith(".parquet")]
        if len(files) > _FOOTERS:
            return df.count()
        hadoop = self.spark._jvm.org.apache.parquet.hadoop
        total = 0
        for s in files:
            reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromStatus(s, self.spark._jsc.hadoopConfiguration()))
            try:
                total += reader.getRecordCount()
            finally:
                reader.close()
        return total

    @contextmanager
    def bucketed(self, df: DataFrame, key: str) -> Iterator[DataFrame]:
        """``df`` in buckets by ``key``, as many as a shuffle has partitions: a join by ``key``
        doesn't move it. The table is dropped at the end of the block."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"symgraph_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
        try:
            yield self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def replace(self, old: DataFrame, df: DataFrame) -> DataFrame:
        out = self.write(df)
        self.drop(old)
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            self._alive.pop(id(df), None)
            remove(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.paths.pop(id(df), None)
        if path:
            self._sized[id(df)] = path
            _KEPT.setdefault(self.spark.sparkContext.applicationId, []).append(path)
        return df

    def folder(self, name: str) -> str:
        """A path for a table of the caller's own, kept like a final table."""
        path = f"{self.root}/{name}"
        _KEPT.setdefault(self.spark.sparkContext.applicationId, []).append(path)
        return path

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths.values():
            remove(self.spark, path)
        self.paths.clear()


class Growing:
    """A table that only grows, a part per level of a loop; no part is written twice.

    ``add`` writes the new rows and returns how many they were (read from the files' footers).
    """

    def __init__(self, scratch: Scratch, first: DataFrame) -> None:
        self.scratch, self.parts, self.total = scratch, [], 0
        self.schema = None
        self.add(first)

    def add(self, df: DataFrame) -> int:
        part = self.scratch.write(df)
        self.schema = self.schema or part.schema
        n = self.scratch.rows(part)
        self.total += n
        if n or not self.parts:
            self.parts.append(part)
        else:
            self.scratch.drop(part)
        return n

    @property
    def last(self) -> DataFrame:
        return self.parts[-1]

    @property
    def df(self) -> DataFrame:
        paths = [self.scratch.paths[id(p)] for p in self.parts]
        return self.scratch.spark.read.schema(self.schema).parquet(*paths)

    def keep(self) -> DataFrame:
        out = self.df
        for p in self.parts:
            self.scratch.keep(p)
        return out
