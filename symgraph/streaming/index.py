"""An index kept up by a stream of file changes, equal to one built from scratch.

Change events are coalesced into bursts; each micro-batch is merged into a versioned table in
one commit that also records the batch, so a batch that is replayed after a failure changes
nothing. Files whose content hash (and extractor version) is stored already are skipped.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import extraction as X
from ..functions import predicates as P
from ..operators.incremental import VersionedTable

#: Milliseconds of quiet that end a burst, and the most paths of a burst that is applied by path.
QUIET_MS = 400
MOST_PATHS = 4096


def bursts(events: DataFrame, quiet_ms: int = QUIET_MS, most: int = MOST_PATHS) -> DataFrame:
    """``(project_id, started, ended, paths, scope)`` from ``(ts, project_id, path, is_dir, kind)``.

    Reads and metadata changes are ignored. A burst is applied path by path (``scoped``) unless
    it names a folder or too many paths; then the whole project is walked (``full``), which is
    always safe. Works on a batch and, with a watermark on ``ts``, on a stream.
    """
    changes = events.where(~F.col("kind").isin("read", "metadata"))
    w = F.session_window("ts", f"{quiet_ms} milliseconds")
    # a sketch instead of the paths themselves: a burst may name very many
    g = changes.groupBy("project_id", w.alias("w")).agg(F.approx_count_distinct("path", 0.01).alias("paths"), F.max("is_dir").alias("_d"))
    scope = F.when(F.col("_d") | (F.col("paths") > most), "full").otherwise("scoped")
    return g.select("project_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths", scope.alias("scope"))


class IncrementalIndex:
    """Extraction records of all files, in a :class:`VersionedTable`.

    ``fingerprint`` is the extractors' version: under another one every file is read anew.
    """

    def __init__(self, spark: SparkSession, path: str, fingerprint: str = "1", whole: Callable[[], DataFrame] | None = None) -> None:
        """``whole``: reads the present checkout, for a walk that is owed after a failed batch."""
        self.spark, self.fingerprint, self.whole = spark, fingerprint, whole
        self.table = VersionedTable(spark, path)
        #: A batch failed, so what the index holds may lag behind: the next one walks everything.
        self.owed = False

    @property
    def generation(self) -> int:
        """Grows with every change; cursors and caches of another generation are void."""
        return self.table.version()

    def changed_only(self, content: DataFrame) -> DataFrame:
        """The files whose hash is not stored under the present fingerprint."""
        hashed = content.withColumn("content_hash", P.content_hash("content"))
        stored = self.table.snapshot()
        if stored is None:
            return hashed
        known = stored.where(F.col("fingerprint") == self.fingerprint).select("project_id", "file_path", "content_hash").distinct()
        return hashed.join(known, ["project_id", "file_path", "content_hash"], "left_anti")

    def apply(self, content: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> int:
        """Merge changed files ``(project_id, file_path, content)`` and drop ``removed`` ones."""
        base = self.table.version()
        done = self.table.manifest(base)["processed"].get("batch", -1)
        if batch is not None and batch <= done:
            return base  # a replay
        keys = ["project_id", "file_path"]
        fresh = self.changed_only(content)
        # the hash goes through the extractor; a file without symbols is stored as such, and not read again
        records = X.extract(fresh, "content_hash").withColumn("fingerprint", F.lit(self.fingerprint))
        touched = fresh.select(*keys)
        if removed is not None:
            touched = touched.union(removed.select(*keys)).distinct()
        stored = self.table.snapshot(positions=True)
        delete = stored.join(touched, keys, "left_semi").select("_file", "_row") if stored is not None else None
        return self.table.commit(add=records, delete=delete, processed={"batch": batch} if batch is not None else None, base=base)

    def on_batch(self, changes: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: ``changes(project_id, file_path, content, deleted, at)``; of
        several changes of a file in a batch the last holds."""
        last = changes.groupBy("project_id", "file_path").agg(F.max(F.struct("at", "deleted", "content")).alias("v")).select("project_id", "file_path", "v.*")
        try:
            if self.owed and self.whole is not None:
                self.refresh(self.whole(), batch)
            else:
                self.apply(last.where(~F.col("deleted")).select("project_id", "file_path", "content"), last.where("deleted"), batch)
        except Exception:
            self.owed = True
            raise
        self.owed = False

    def follow(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)

    def refresh(self, content: DataFrame, batch: int | None = None) -> int:
        """A full walk: whatever it does not see is gone."""
        stored = self.table.snapshot()
        gone = None
        if stored is not None:
            keys = ["project_id", "file_path"]
            gone = stored.select(*keys).distinct().join(content.select(*keys), keys, "left_anti")
        return self.apply(content, gone, batch)

    def roles(self) -> dict[str, DataFrame] | None:
        rows = self.table.snapshot()
        return X.tables(rows) if rows is not None else None


class Snapshot:
    """What ``read`` gives, read again once it is older than ``ttl_s``: a batch sees one state of the
    working tree, and no later one than that."""

    def __init__(self, read: Callable[[], DataFrame], ttl_s: float = 5.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.read, self.ttl_s, self.clock = read, ttl_s, clock
        self._held: tuple[float, DataFrame] | None = None

    def get(self) -> DataFrame:
        now = self.clock()
        if self._held is None or now - self._held[0] >= self.ttl_s:
            self._held = (now, self.read())
        return self._held[1]


# Seconds in which a repeated touch does not count again, and the half-life.
COOLDOWN_S = 300
HALF_LIFE_S = 600
_RECENCY = "project_id string, file_path string, touched_ms bigint, touches bigint, recency double"


def session_recency(touches: DataFrame, now_ms: int, forget_ms: int = 6 * HALF_LIFE_S * 1000) -> DataFrame:
    """How recently each file was worked on, as state per file on ``(project_id, file_path, at_ms)``.

    A touch within the cooldown of the last counted one does not count. State that was idle for
    ``forget_ms`` of processing time is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (-1, 0)
        for pdf in batches:
            for at in sorted(int(x) for x in pdf["at_ms"]):
                if last < 0 or at - last >= COOLDOWN_S * 1000:
                    n += 1
                last = max(last, at)
        state.update((last, n))
        state.setTimeoutDuration(forget_ms)
        age = max(0, now_ms - last) / 1000
        yield pd.DataFrame([(*key, last, n, math.pow(0.5, age / HALF_LIFE_S))], columns=["project_id", "file_path", "touched_ms", "touches", "recency"])

    return touches.groupBy("project_id", "file_path").applyInPandasWithState(step, _RECENCY, "last bigint, n bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)
