"""Review risk of changed symbols, and the reasons for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P
from .reads import related


def weights(churn: bool = True, flow: bool = True) -> dict[str, float]:
    """The weights without factors that no data backs, scaled back to one."""
    kept = {k: w for k, w in D.RISK.items() if (churn or k != "churn") and (flow or k != "flow")}
    total = sum(kept.values())
    return {k: kept.get(k, 0.0) / total for k in D.RISK}


def factors() -> dict[str, Column]:
    """Each factor in 0..1 from columns callers, churn, cross_app, cross_project, diff, flow,
    keyword and covering."""
    s = D.RISK_SATURATION
    out = {k: P.saturating(k, s[k]) for k in ("callers", "churn", "cross_app", "cross_project", "diff")}
    out["flow"] = F.least(F.greatest(F.col("flow") / s["flow"], F.lit(0.0)), F.lit(1.0))
    out["security"] = F.col("keyword").isNotNull().cast("double")
    out["test_gap"] = 1.0 - P.saturating("covering", s["tests"])
    return out


def score(w: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for k, f in factors().items():
        total = total + f * F.lit(w[k])
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def reasons(w: dict[str, float], most: int = 3) -> Column:
    """The strongest contributions as text, ties in the order of the factors."""
    c = lambda x: F.col(x).cast("string")
    text = {
        "callers": F.concat(c("callers"), F.lit(" callers")),
        "churn": F.concat(c("churn"), F.lit(f" commits/{D.CHURN_DAYS}d")),
        "cross_app": F.concat(c("cross_app"), F.lit(" cross-app callers")),
        "cross_project": F.concat(c("cross_project"), F.lit(" cross-project callers")),
        "diff": F.concat(c("diff"), F.lit(" lines changed")),
        "flow": F.concat(F.lit('in "'), F.col("flow_name"), F.lit('" flow')),
        "security": F.concat(F.lit("security-sensitive ("), F.col("keyword"), F.lit(")")),
        "test_gap": F.when(F.col("covering") == 0, "no tests").otherwise(F.concat(F.lit("only "), c("covering"), F.lit(" covering test(s)"))),
    }
    rows = [F.struct((-f * F.lit(w[k])).alias("c"), F.lit(i).alias("i"), text[k].alias("t")) for i, (k, f) in enumerate(factors().items())]
    said = F.filter(F.array_sort(F.array(*rows)), lambda x: (x["c"] < 0) & x["t"].isNotNull())
    return F.array_join(F.transform(F.slice(said, 1, most), lambda x: x["t"]), ", ")


def changed(touched: DataFrame, nodes: DataFrame, edges: DataFrame, participation: DataFrame | None, churn: DataFrame | None, limit: int = 500) -> DataFrame:
    """Changed symbols ``touched(node_id, lines)`` with their risk, riskiest first.

    Callers are distinct (kind, caller) pairs; coverage counts references from tests; a symbol
    in a test file is its own coverage and never security sensitive.
    """
    n = nodes.select("id", "project_id", "name", "qualified_name", "file_path", "start_line", "kind")
    t = touched.join(n, touched["node_id"] == n["id"]).drop("node_id")
    mine = edges.where(F.col("kind") != "contains").join(touched.select(F.col("node_id").alias("target")), "target", "left_semi")
    pairs = related(mine, nodes, "source").join(t.select(F.col("id").alias("symbol"), F.col("project_id").alias("t_project"), F.col("file_path").alias("t_file")), "symbol")
    facts = pairs.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("callers"),
        F.sum(F.when(P.is_covering("kind", "file_path"), F.col("times")).otherwise(0)).alias("covering"),
        F.count(F.when(P.app_segment("file_path") != P.app_segment("t_file"), 1)).alias("cross_app"),
        F.count(F.when(F.col("o_project") != F.col("t_project"), 1)).alias("cross_project"),
    )
    rows = t.join(facts, t["id"] == facts["symbol"], "left").drop("symbol")
    if participation is not None:
        rows = rows.join(participation.select(F.col("node").alias("id"), F.col("total").alias("flow"), "flow_name"), "id", "left")
    else:
        rows = rows.withColumn("flow", F.lit(0.0)).withColumn("flow_name", F.lit(None).cast("string"))
    if churn is not None:
        rows = rows.join(churn.select("project_id", "file_path", F.col("commits").alias("churn")), ["project_id", "file_path"], "left")
    else:
        rows = rows.withColumn("churn", F.lit(0).cast("long"))
    test = P.is_test_path("file_path")
    zero = F.lit(0).cast("long")
    rows = rows.select(
        "id",
        "kind",
        "file_path",
        "start_line",
        F.col("lines").alias("diff"),
        *[F.coalesce(c, zero).alias(c) for c in ("callers", "cross_app", "cross_project", "churn")],
        F.when(test, F.lit(D.RISK_SATURATION["tests"]).cast("long")).otherwise(F.coalesce("covering", zero)).alias("covering"),
        F.coalesce("flow", F.lit(0.0)).alias("flow"),
        "flow_name",
        F.when(~test, P.security_keyword("name", "qualified_name")).alias("keyword"),
    )
    w = weights(churn is not None, participation is not None)
    scored = rows.withColumn("risk", score(w)).withColumn("reasons", reasons(w))
    return scored.orderBy(F.desc("risk"), F.desc("callers"), "file_path", "start_line", "id").limit(limit)
