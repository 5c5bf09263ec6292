"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name``; the scan reads only the columns and row groups a plan asks for."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_kind(col: Column) -> Column:
    """Labels compare trimmed and in lower case; a blank label is null."""
    return F.nullif(F.lower(F.trim(col)), F.lit(""))


#: Parts that rows with a null key are spread over.
_SPREAD = 64


def left_join(left: DataFrame, right: DataFrame, on: list[str], spread: str) -> DataFrame:
    """A left join whose rows with a null key are spread by the column ``spread``.

    They match nothing, yet a plain join sends them all to one task.
    """
    none = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    part = F.when(none, F.pmod(F.xxhash64(spread), F.lit(_SPREAD)) + 1).otherwise(F.lit(0).cast("long"))
    # always 0, in a form that isn't a constant to the optimiser, which would drop the key
    zero = F.pmod(F.xxhash64(*on), F.lit(1).cast("long"))
    return left.withColumn("_part", part).join(right.withColumn("_part", zero), [*on, "_part"], "left").drop("_part")


def latest_nodes(nodes: DataFrame, *columns: str) -> DataFrame:
    """The version of each node that holds: the greatest ``updated_at`` of its id.

    One map-side combined aggregate instead of a window, so a hot id never sorts in one task.
    Versions of equal ``updated_at`` resolve to the greatest row; a null time is the oldest.
    Null ids are dropped.
    """
    want = [c for c in columns if c != "id"]
    best = F.max(F.struct(F.coalesce("updated_at", F.lit(-(2**63))).alias("_at"), *want)).alias("_v")
    return nodes.where(F.col("id").isNotNull()).groupBy("id").agg(best).select("id", *[F.col("_v")[c].alias(c) for c in want])


def distinct_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """One row per ``edge_id`` (delivered twice, an edge still counts once)."""
    want = [c for c in columns if c != "edge_id"]
    return (
        edges.where(F.col("edge_id").isNotNull())
        .groupBy("edge_id")
        .agg(F.max(F.struct(*want)).alias("_v"))
        .select("edge_id", *[F.col("_v")[c].alias(c) for c in want])
    )
