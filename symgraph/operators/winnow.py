"""A typed filter over many axes, compiled to one lazy plan.

Criteria are validated on the driver, put in the order of their cost and turned into predicates.
Facts that need a join (callers, coverage, flows, churn, changes, callees by kind) are joined
only if a criterion or the ranking asks for them, each as a semi-join or a pre-aggregated side,
so a symbol with very many callers stays one row. Values compare in ASCII lower case; lists are
separated by commas.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P
from ..functions.arguments import parse_date
from .risk import score

# The axes, the comparisons each allows and the cost class of its evaluation.
_ANY = ("eq", ">=", ">", "<=", "<")
AXES: dict[str, tuple[tuple[str, ...], int]] = {
    "kind": (("eq", "in"), 0),
    "language": (("eq", "in"), 0),
    "project": (("eq", "in"), 0),
    "name": (("contains", "eq", "matches"), 0),
    "file": (("contains", "matches"), 0),
    "decorator": (("contains",), 0),
    "lines": (_ANY, 0),
    "called_by": (("contains",), 1),
    "callers": (_ANY, 1),
    "changed_since": ((">=",), 1),
    "churn": (_ANY, 1),
    "in_flow": (("contains", "eq"), 1),
    "risk": ((">=", ">"), 1),
    "tested": (("eq",), 1),
    "calls": (("contains",), 2),
    "extends": (("contains",), 2),
    "relates_to": (("contains",), 2),
    "renders": (("contains",), 2),
}
ALIASES = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<", "==": "eq"}
RANKS = ("callers", "churn", "criticality", "lines", "name", "risk")
MOST_CRITERIA = 12
_COMPARE = {"eq": operator.eq, ">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}


@dataclass(frozen=True)
class Criterion:
    axis: str
    op: str
    value: object
    days: int = D.CHURN_DAYS


def _list(raw: str) -> list[str]:
    lower = raw.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [x.strip() for x in lower.split(",") if x.strip()]


def parse(criteria: list[tuple]) -> list[Criterion]:
    """``(axis, op, value[, window_days])`` validated and ordered by cost (stable)."""
    if len(criteria) > MOST_CRITERIA:
        raise ValueError(f"more than {MOST_CRITERIA} criteria")
    out = []
    for axis, op, raw, *rest in criteria:
        axis, op = axis.strip(), ALIASES.get(op.strip(), op.strip())
        if axis not in AXES:
            raise ValueError(f"unknown axis {axis!r}; one of {', '.join(sorted(AXES))}")
        if op not in AXES[axis][0]:
            raise ValueError(f"{axis} takes {', '.join(AXES[axis][0])}, not {op!r}")
        raw = str(raw).strip()
        if not raw or len(raw) > 256:
            raise ValueError(f"unusable value for {axis}")
        truth = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(raw.lower())
        value: object = _list(raw)
        if axis == "kind" and not set(value) <= set(D.NODE_KINDS) or axis == "language" and not set(value) <= set(D.NODE_LANGUAGES):
            raise ValueError(f"unusable value for {axis}: {raw!r}")
        if axis in ("callers", "churn", "lines"):
            value = int(raw)
        elif axis == "risk":
            value = float(raw)
            if not 0 <= value <= 1:
                raise ValueError("risk lies in 0..1")
        elif axis == "changed_since":
            value = parse_date(raw)
        elif axis == "tested" or axis == "in_flow" and truth is not None:
            if truth is None:
                raise ValueError("tested is true or false")
            value = truth
        out.append(Criterion(axis, op, value, max(1, rest[0]) if rest and rest[0] else D.CHURN_DAYS))
    return sorted(out, key=lambda c: AXES[c.axis][1])


def text_matches(op: str, needles: list[str], text: Column) -> Column:
    low = P.ascii_lower(text)
    if op in ("eq", "in"):
        return low.isin(*needles) if needles else F.lit(False)
    tests = [P.glob(n, text) if op == "matches" else low.contains(n) for n in needles]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def _column(c: Criterion) -> Column:
    if c.axis in ("kind", "language"):
        return F.col(c.axis).isin(*c.value)
    if c.axis == "project":
        return text_matches(c.op, c.value, F.col("project_id"))
    if c.axis in ("name", "file"):
        return text_matches(c.op, c.value, F.col("name" if c.axis == "name" else "file_path"))
    if c.axis == "decorator":
        return F.coalesce(text_matches(c.op, c.value, F.col("decorators")), F.lit(False))
    return _COMPARE[c.op](F.col("lines"), F.lit(c.value))


def winnow(
    nodes: DataFrame,
    edges: DataFrame,
    criteria: list[tuple],
    rank: str = "callers",
    limit: int | None = 50,
    flows: DataFrame | None = None,
    members: DataFrame | None = None,
    churn: DataFrame | None = None,
    changed: DataFrame | None = None,
) -> DataFrame:
    """The symbols that meet all criteria, ranked.

    ``flows``/``members``: of :mod:`symgraph.operators.flows`; ``churn(project_id, file_path,
    commits)``; ``changed(qualified_name, committed_at)``. Axes whose facts are not given match
    as if there were none. The result has the columns callers, lines, churn, covered,
    criticality and risk only as far as they were needed, with the rank's among them.
    """
    if rank not in RANKS:
        raise ValueError(f"rank is one of {', '.join(RANKS)}")
    cs = parse(criteria)
    axes = {c.axis for c in cs}
    need_risk = "risk" in axes or rank == "risk"
    df = nodes.select("id", "project_id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "decorators")
    df = df.withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
    for c in cs:
        if AXES[c.axis][1] == 0:
            df = df.where(_column(c))
    df = df.drop("decorators")
    calls = edges.where(F.col("kind") != "contains")
    if need_risk or rank == "callers" or "callers" in axes:
        known = nodes.select(F.col("id").alias("source"))
        count = calls.select("target", "source").distinct().join(known, "source", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
        df = df.join(count, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0).cast("long")))
    if need_risk or "tested" in axes:
        src = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_path"))
        cov = edges.join(src, "source").where(P.is_covering("kind", "source_path")).select(F.col("target").alias("id")).distinct().withColumn("cov", F.lit(True))
        df = df.join(cov, "id", "left").withColumn("covered", F.coalesce("cov", F.lit(False)) | P.is_test_path("file_path")).drop("cov")
    if need_risk or rank == "churn" or "churn" in axes:
        if churn is not None:
            df = df.join(churn.select("project_id", "file_path", F.col("commits").alias("churn")), ["project_id", "file_path"], "left")
        df = df.withColumn("churn", F.coalesce("churn", F.lit(0).cast("long")) if churn is not None else F.lit(0).cast("long"))
    if need_risk or rank == "criticality":
        if flows is not None:
            top = members.join(flows.select("flow", "criticality"), "flow").groupBy(F.col("node").alias("id")).agg(F.max("criticality").alias("criticality"))
            df = df.join(top, "id", "left").withColumn("criticality", F.coalesce("criticality", F.lit(0.0)))
        else:
            df = df.withColumn("criticality", F.lit(0.0))
    if need_risk:
        zero = F.lit(0).cast("long")
        facts = df.withColumns(
            {
                "cross_app": zero,
                "cross_project": zero,
                "diff": zero,
                "flow": F.col("criticality"),
                "keyword": P.security_keyword("name", "qualified_name"),
                "covering": F.when(F.col("covered"), D.RISK_SATURATION["tests"]).otherwise(0),
            }
        )
        df = facts.withColumn("risk", score(D.RISK)).drop("cross_app", "cross_project", "diff", "flow", "keyword", "covering")
    for c in cs:
        if c.axis in ("callers", "churn", "risk"):
            df = df.where(_COMPARE[c.op](F.col(c.axis), F.lit(c.value)))
        elif c.axis == "tested":
            df = df.where(F.col("covered") == F.lit(c.value))
        elif c.axis == "changed_since":
            late = changed.where(F.col("committed_at") >= c.value).select("qualified_name").distinct() if changed is not None else None
            df = df.join(late, "qualified_name", "left_semi") if late is not None else df.limit(0)
        elif c.axis == "in_flow":
            held = members.select(F.col("node").alias("id"), "flow") if members is not None else None
            if held is None:
                df = df.where(F.lit(c.value is False))
            elif isinstance(c.value, bool):
                df = df.join(held.select("id").distinct(), "id", "left_semi" if c.value else "left_anti")
            else:
                named = flows.where(text_matches(c.op, c.value, F.col("name"))).select("flow")
                df = df.join(held.join(named, "flow", "left_semi").select("id").distinct(), "id", "left_semi")
        elif c.axis == "called_by":
            by = nodes.where(text_matches(c.op, c.value, F.col("name"))).select(F.col("id").alias("source"))
            df = df.join(calls.join(by, "source", "left_semi").select(F.col("target").alias("id")).distinct(), "id", "left_semi")
        elif AXES[c.axis][1] == 2:
            to = nodes.where(text_matches(c.op, c.value, F.col("name"))).select(F.col("id").alias("target"))
            out = edges.where(F.col("kind") == c.axis).join(to, "target", "left_semi").select(F.col("source").alias("id")).distinct()
            df = df.join(out, "id", "left_semi")
    first = F.col("name") if rank == "name" else F.desc(rank)
    ordered = df.orderBy(first, "file_path", "start_line", "id")
    return ordered if limit is None else ordered.limit(limit)


def cascade(nodes: DataFrame, edges: DataFrame, criteria: list[tuple], **facts: DataFrame) -> DataFrame:
    """``(step, criterion, left)``: how many symbols survive each further criterion."""
    parse(criteria)
    order = [criteria[i] for i in sorted(range(len(criteria)), key=lambda i: AXES[criteria[i][0].strip()][1])]
    # each criterion is evaluated once; a symbol is left after a step if it passed all up to there
    passed = nodes.select("id", F.lit(1).cast("long").alias("bit"))
    for i, c in enumerate(order, 1):
        passed = passed.unionByName(winnow(nodes, edges, [c], "name", None, **facts).select("id", F.lit(1 << i).cast("long").alias("bit")))
    each = passed.groupBy("id").agg(F.bit_or("bit").alias("bits"))
    upto = [(1 << (i + 1)) - 1 for i in range(len(order) + 1)]
    sums = each.agg(*[F.count(F.when(F.col("bits").bitwiseAND(F.lit(m).cast("long")) == m, 1)).alias(f"s{i}") for i, m in enumerate(upto)])
    said = ["all", *(" ".join(map(str, c[:3])) for c in order)]
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(said[i]).alias("criterion"), F.col(f"s{i}").alias("left")) for i in range(len(upto))])
    return sums.select(F.explode(steps).alias("x")).select("x.*")
