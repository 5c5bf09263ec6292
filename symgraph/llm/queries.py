"""Queries p1, p2 and p6 to p10 over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import VersionedTable
from ..operators.packed import packed_items
from ..plans.registry import Registry
from ..session import Scratch
from ..sources.tables import distinct_edges, latest_nodes, norm_kind, read
from . import docpairs, frequency, handwritten, mixing, tokenize, truncated, unparsable

registry = Registry()


# --- p1: files not written by hand -----------------------------------------------------------


def _p1(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify(read(spark, d, "files"), read(spark, d, "file_content"))


@registry.query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).select("project_id", "path")


@registry.query("p1_reasons")
def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)


@registry.query("p1_handwritten")
def p1_handwritten(spark: SparkSession, d: str) -> DataFrame:
    """What remains, with the greatest known size of each file."""
    files = read(spark, d, "files")
    kept = files.where(F.col("path").isNotNull()).groupBy("project_id", "path").agg(F.max("size_bytes").alias("size_bytes"))
    return kept.join(_p1(spark, d), ["project_id", "path"], "left_anti")


# --- p2: functions with their documentation --------------------------------------------------


@registry.query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs whose documentation is the node's own."""
    return docpairs.resolve_docs(read(spark, d, "nodes"), read(spark, d, "edges")).where("id = doc_from").select("id")


@registry.query("p2_pairs")
def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(read(spark, d, "nodes"), read(spark, d, "edges"), read(spark, d, "file_content"))


# --- p6: terms -----------------------------------------------------------------------------


def _counts(spark: SparkSession, d: str, decorators: bool = True) -> DataFrame:
    """The counts after two runs: one over what was written before the last successful run of the
    index began, with all links (they have no time), and one over the delta since.
    """
    nodes, runs = read(spark, d, "nodes"), read(spark, d, "index_runs")
    since = runs.where("status = 'ok'").agg(F.max("started_at")).first()[0] or 0
    scratch = Scratch(spark, "terms")
    symbols, links = (VersionedTable(spark, scratch.folder(n)) for n in ("nodes", "edges"))
    counts = frequency.TermCounts(spark, scratch.folder("counts"))
    record = F.struct("kind", "decorators").alias("record")

    def of_symbols(delta: DataFrame) -> DataFrame:
        kinds = delta.select(F.lit("nodes.kind").alias("field"), F.col("_delta").alias("sign"), F.array(norm_kind(F.col("record.kind"))).alias("terms"))
        if not decorators:
            return kinds
        packed = packed_items(delta.select("id", "_delta", F.col("record.decorators").alias("packed")), "id", "packed", at_sign=True)
        return kinds.unionByName(packed.select(F.lit("nodes.decorators").alias("field"), F.col("_delta").alias("sign"), F.col("items").alias("terms")))

    def of_links(delta: DataFrame) -> DataFrame:
        return delta.select(F.lit("edges.kind").alias("field"), F.col("_delta").alias("sign"), F.array(norm_kind(F.col("kind"))).alias("terms"))

    late = F.col("updated_at") >= since
    symbols.commit(add=latest_nodes(nodes.where(late.isNull() | ~late), "kind", "decorators").select("id", record))
    links.commit(add=distinct_edges(read(spark, d, "edges"), "kind"))
    sources = {"nodes": (symbols, of_symbols), "edges": (links, of_links)}
    counts.update(sources)
    symbols.merge(latest_nodes(nodes.where(late), "kind", "decorators").select("id", record), ["id"], "record", full=False)
    counts.update(sources)
    return counts.counts()


@registry.query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.mark(_counts(spark, d)).where(F.col("mark").isNotNull()).select("field", "term", "mark")


_KIND_COUNTS = """
WITH n AS (SELECT id, lower(trim(kind)) AS term FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
e AS (SELECT DISTINCT edge_id AS id, lower(trim(kind)) AS term FROM edges),
t AS (SELECT 'nodes.kind' AS field, term FROM n UNION ALL SELECT 'edges.kind', term FROM e)
SELECT field, term, count(*) AS occurrences, count(*) AS records FROM t WHERE term <> '' GROUP BY field, term
"""


@registry.query("p6_kind_counts", _KIND_COUNTS)
def p6_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the two fields that SQL can express."""
    return _counts(spark, d, decorators=False).where(F.col("term").isNotNull())


@registry.query("p6_counts")
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.mark(_counts(spark, d))


# --- p7: files that do not parse ---------------------------------------------------------------


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return unparsable.parse_all(read(spark, d, "files"), read(spark, d, "file_content"))


@registry.query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).where(F.col("error").isNotNull()).select("project_id", "path")


@registry.query("p7_files")
def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """The cases with the error and, for a wrong extension, the language the text is valid in."""
    return _p7(spark, d).where(F.col("error").isNotNull())


@registry.query("p7_rates")
def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return unparsable.rates(_p7(spark, d))


# --- p8: token ids -------------------------------------------------------------------------


@registry.query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(read(spark, d, "documents"), "doc_id", "text")


# --- p9: mixing ----------------------------------------------------------------------------


def _sized(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "sized")  # lengths are read several times, texts are encoded once
    return scratch.keep(scratch.write(tokenize.token_counts(read(spark, d, "documents"), ["doc_id", "source"], "text")))


@registry.query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), read(spark, d, "mix_targets"))


@registry.query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    targets = read(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


# --- p10: truncated texts --------------------------------------------------------------------


@registry.query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated.judge(read(spark, d, "documents")).where(F.col("reason").isNotNull()).select("doc_id").distinct()


@registry.query("p10_reasons")
def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncated.judge(read(spark, d, "documents")).where(F.col("reason").isNotNull())


@registry.query("p10_rates")
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    docs = read(spark, d, "documents")
    return truncated.rates(docs, truncated.judge(docs))
