"""How often every distinct value or term occurs, kept up by signed deltas.

Method: the counts are a persistent :class:`VersionedTable` of ``(field, term, occurrences,
records)`` in folders by a hash of both. A run takes the delta between the version of a source
table that it counted last and the present one: added, changed and deleted records only, with
signs. They are reduced to a change per term (partial aggregation before the shuffle), merged into
the folders that these changes touch, and committed together with the source's version. A term
that is left in no record disappears. A first run is the same with every record an added one.

Records arrive as ``(field, sign, terms)`` with an array of all occurrences. A record counts once
for a term it has several times. The number of records with at least one term in a field is kept
under a null term. Defined results: null terms are ignored; an empty table gives no counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import VersionedTable
from ..session import Scratch

#: Folders of the persistent counts by a hash of field and term.
BUCKETS = 16
_COUNTS = "field string, term string, occurrences bigint, records bigint"


def term_deltas(signed: DataFrame) -> DataFrame:
    """``(field, term, occurrences, records)`` changes from ``(field, sign, terms array)``.

    A record gives a row per occurrence, one per distinct term and one for itself; a term that a
    third of all records hold is one row per task before anything is shuffled.
    """
    entry = lambda t, n, m: F.struct(t.alias("term"), F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"))
    terms = F.filter("terms", lambda t: t.isNotNull())
    own = F.array(entry(F.lit(None).cast("string"), 0, 1))
    rows = signed.select("field", "sign", terms.alias("t")).where(F.size("t") > 0)
    each = F.concat(F.transform("t", lambda t: entry(t, 1, 0)), F.transform(F.array_distinct("t"), lambda t: entry(t, 0, 1)), own)
    return (
        rows.select("field", "sign", F.explode(each).alias("e"))
        .groupBy("field", F.col("e.term").alias("term"))
        .agg(F.sum(F.col("sign") * F.col("e.n")).alias("occurrences"), F.sum(F.col("sign") * F.col("e.m")).alias("records"))
    )


def merge_counts(counts: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The counts after ``deltas``: one aggregate over both, without a join."""
    rows = deltas if counts is None else counts.select("field", "term", "occurrences", "records").unionByName(deltas)
    merged = rows.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return merged.where((F.col("occurrences") != 0) | (F.col("records") != 0))


class TermCounts:
    """Counts at ``path`` that follow source tables.

    ``buckets`` is the number of folders: a run rewrites those in which a count changed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        self.table = VersionedTable(spark, path)

    def update(self, sources: dict[str, tuple[VersionedTable, Callable[[DataFrame], DataFrame]]]) -> int:
        """Count what changed in the sources since the last run.

        Of each source by name: the table, and what turns its records with ``_delta`` into
        ``(field, sign, terms)``. The counts and the versions they stand for are one commit, so a
        run that dies neither skips nor repeats.
        """
        base = self.table.version()
        processed = self.table.manifest(base)["processed"]
        now = {name: source.version() for name, (source, _) in sources.items()}
        if all(processed.get(name) == v for name, v in now.items()):
            return base
        deltas = [(terms, source.diff(int(processed.get(name, 0)), now[name])) for name, (source, terms) in sources.items()]
        signed = [terms(delta) for terms, delta in deltas if delta is not None]
        if not signed:
            return self.table.commit(processed=now, base=base)
        bucket = F.pmod(F.xxhash64("field", "term"), F.lit(self.buckets)).cast("int")
        changes = term_deltas(reduce(DataFrame.unionByName, signed))
        held = self.table.files(base)
        if not held:
            return self.table.commit(add=merge_counts(None, changes).withColumn("_b", bucket).repartition("_b"), processed=now, base=base, partition_by=["_b"])
        scratch = Scratch(self.spark, "deltas")
        changes = scratch.write(changes.where("occurrences <> 0 OR records <> 0").withColumn("_b", bucket))
        try:
            touched = {r[0] for r in changes.select("_b").distinct().collect()}  # numbers of folders
            old = [f for f in held if int(f.split("/_b=")[1].split("/")[0]) in touched]
            merged = merge_counts(self.table.read(old, base) if old else None, changes.drop("_b"))
            return self.table.commit(add=merged.withColumn("_b", bucket).repartition("_b"), drop=old, processed=now, base=base, partition_by=["_b"])
        finally:
            scratch.drop(changes)

    def counts(self) -> DataFrame:
        """``(field, term, occurrences, records)``; the null term of a field holds its records."""
        rows = self.table.snapshot()
        return self.spark.createDataFrame([], _COUNTS) if rows is None else rows


def mark(counts: DataFrame, rare: int = 5, common: float = 0.1) -> DataFrame:
    """``(field, term, occurrences, records, share, mark)`` with mark rare, common or null.

    Rare: in fewer than ``rare`` records. Common: in more than ``common`` of the records with a
    term in the field. A term that is both is rare. The totals are one row per field.
    """
    # one entry per field, read as a scalar: a join by field would gather a field's terms
    totals = counts.where(F.col("term").isNull()).agg(F.map_from_entries(F.collect_list(F.struct("field", "records")))).scalar()
    terms = counts.where(F.col("term").isNotNull()).withColumn("_all", totals[F.col("field")])
    share = F.col("records") / F.col("_all")
    verdict = F.when(F.col("records") < rare, "rare").when(F.col("records") > common * F.col("_all"), "common")
    return terms.select("field", "term", "occurrences", "records", share.alias("share"), verdict.alias("mark"))
