"""Measures of retrieval: reciprocal rank, precision, recall, F1, token sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reciprocal_rank(ranked: DataFrame, truth: DataFrame, cut: int = 20) -> DataFrame:
    """``(questions, mrr)``: ``ranked(question, item, rank)`` against ``truth(question, item)``.

    The first right item within ``cut`` counts, none counts as 0; questions without a truth are
    left out.
    """
    first = ranked.where(F.col("rank") <= cut).join(truth, ["question", "item"], "left_semi").groupBy("question").agg(F.min("rank").alias("rank"))
    rows = truth.select("question").distinct().join(first, "question", "left")
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def accuracy(predicted: DataFrame, truth: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Precision, recall and F1 per key of predicted against true items (0 where undefined)."""
    p = predicted.select(*keys, item).distinct().withColumn("p", F.lit(1))
    t = truth.select(*keys, item).distinct().withColumn("t", F.lit(1))
    both = p.select(*keys, item, "p", F.lit(0).alias("t")).unionByName(t.select(*keys, item, F.lit(0).alias("p"), "t")).groupBy(*keys, item).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    g = both.groupBy(*keys).agg(F.sum("p").alias("np"), F.sum("t").alias("nt"), F.sum(F.col("p") * F.col("t")).alias("hit"))
    precision = F.when(F.col("np") > 0, F.col("hit") / F.col("np")).otherwise(0.0)
    recall = F.when(F.col("nt") > 0, F.col("hit") / F.col("nt")).otherwise(0.0)
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("np") + F.col("nt"))).otherwise(0.0)
    return g.select(*keys, precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def approximate_tokens(text: str) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")
