"""Queries of graph walks, flows, risk, filters, search, resolution, mutations and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P
from ..operators import flows as FL
from ..operators import graph as GR
from ..operators import mutations as M
from ..operators import reads as R
from ..operators import resolution as RES
from ..operators import risk as RK
from ..operators import search as SE
from ..operators import temporal as T
from ..operators.incremental import manifest_diff
from ..operators.winnow import winnow
from ..sources import graph as G
from ..sources.tables import read
from . import sqltext as S
from .registry import Registry
from .relational import _HUNKS, SINCE, hunks

registry = Registry()
q = registry.query

_STEP = "step AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE kind IN ({}) AND source IS NOT NULL AND target IS NOT NULL)"


# --- hierarchies of classes (J2, J3, J11-J13) ------------------------------------------------------


_UP = f"""{_STEP.format("'extends'")}, up AS (SELECT src AS sub, src AS base, 0 AS depth FROM step UNION SELECT u.sub, s.dst, u.depth + 1 FROM up u JOIN step s ON s.src = u.base WHERE u.depth < 16),
sup AS (SELECT sub, base, min(depth) AS depth FROM up GROUP BY ALL)"""


@q("subclasses", f"WITH RECURSIVE {S.E}, {_UP} SELECT base, sub, CAST(depth AS INTEGER) AS depth FROM sup WHERE depth > 0 AND base <> sub")
def subclasses(s: SparkSession, d: str) -> DataFrame:
    return GR.subclasses(G.edges(s, d, "source", "target"))


@q(
    "model_fields",
    f"""WITH RECURSIVE {S.N}, {S.E}, {_UP}, k AS (SELECT id, name AS base_name FROM n WHERE kind IN ('class', 'model')),
v AS (SELECT sub, base, min(depth) AS depth FROM (SELECT id AS sub, id AS base, 0 AS depth FROM k UNION ALL SELECT * FROM sup) GROUP BY ALL),
o AS (SELECT DISTINCT e.source AS base, n.id AS field, n.name, n.start_line FROM e JOIN n ON n.id = e.target AND n.kind = 'field' WHERE e.kind = 'contains')
SELECT v.sub AS model, field, o.name, v.base, CAST(depth AS INTEGER) AS depth,
  row_number() OVER (PARTITION BY v.sub, o.name ORDER BY CASE WHEN depth = 0 THEN 0 ELSE 1 END, base_name NULLS FIRST, start_line NULLS FIRST, field) > 1 AS shadowed
FROM v JOIN k ks ON ks.id = v.sub LEFT JOIN k kb ON kb.id = v.base JOIN o ON o.base = v.base""".replace("base_name NULLS", "kb.base_name NULLS"),
)
def model_fields(s: SparkSession, d: str) -> DataFrame:
    return GR.model_fields(G.edges(s, d, "source", "target"), G.nodes(s, d, "name", "start_line"))


_OWNED = "o AS (SELECT DISTINCT e.source AS cls, n.id AS method, n.name FROM e JOIN n ON n.id = e.target AND n.kind = 'method' WHERE e.kind = 'contains')"


@q(
    "inherited_methods",
    f"""WITH RECURSIVE {S.N}, {S.E}, {_UP}, {_OWNED}, a AS (SELECT sub AS cls, name, depth, count(DISTINCT method) AS c, min(method) AS method FROM sup JOIN o ON o.cls = sup.base WHERE depth > 0 GROUP BY ALL)
SELECT cls, name, method FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY cls, name ORDER BY depth) = 1) WHERE c = 1""",
)
def inherited_methods(s: SparkSession, d: str) -> DataFrame:
    return GR.inherited_methods(G.edges(s, d, "source", "target"), G.nodes(s, d, "name"))


@q(
    "method_overrides",
    f"""WITH RECURSIVE {S.N}, {S.E}, {_UP}, {_OWNED} SELECT a.method AS source, b.method AS target FROM o a JOIN sup ON sup.sub = a.cls AND sup.depth > 0 JOIN o b ON b.cls = sup.base AND b.name = a.name
WHERE a.method <> b.method QUALIFY row_number() OVER (PARTITION BY a.method ORDER BY depth, b.method) = 1""",
)
def method_overrides(s: SparkSession, d: str) -> DataFrame:
    return GR.overrides(G.edges(s, d, "source", "target"), G.nodes(s, d, "name"))


@q(
    "symbol_owners",
    rf"""WITH {S.N}, m AS (SELECT id AS member, project_id, regexp_replace(qualified_name, '\.[^.]*$', '') AS up FROM n WHERE contains(string_split(qualified_name, '::')[-1], '.'))
SELECT member, min(n.id) AS owner FROM m JOIN n ON n.project_id = m.project_id AND n.qualified_name = m.up GROUP BY member""",
)
def symbol_owners(s: SparkSession, d: str) -> DataFrame:
    return GR.owners(G.nodes(s, d, "project_id", "qualified_name"))


# --- impact, paths, features, ancestry (J1, J4, J5, J6, J14, L9) -----------------------------------------


def _level(k: int) -> str:
    before = " UNION ALL ".join(f"SELECT seed, node FROM l{i}" for i in range(k))
    return f"""l{k} AS (SELECT f.seed, c.dst AS node, {k} AS level, arg_min(c.kind, [CAST({S.edge_rank('c.kind')} AS VARCHAR), c.kind]) AS kind FROM (SELECT * FROM l{k - 1} WHERE reached) f JOIN c ON c.src = f.node
  WHERE NOT EXISTS (SELECT 1 FROM ({before}) v WHERE v.seed = f.seed AND v.node = c.dst) GROUP BY f.seed, c.dst),
m{k} AS (SELECT *, kind IN ({S.quoted(D.REACH_KINDS)}) AS reached FROM l{k})""".replace(f"FROM (SELECT * FROM l{k - 1} WHERE", f"FROM (SELECT * FROM {'l0' if k == 1 else f'm{k - 1}'} WHERE")


@q(
    "impact_of_models",
    f"""WITH {S.N}, {S.E}, c AS (SELECT DISTINCT target AS src, source AS dst, e.kind FROM e JOIN n ON n.id = source WHERE e.kind <> 'contains' AND n.kind <> 'file' AND NOT {S.test_path('file_path')}),
l0 AS (SELECT id AS seed, id AS node, 0 AS level, '' AS kind, true AS reached FROM n WHERE n.kind = 'model'), {_level(1)}, {_level(2)}
SELECT seed, level, node, kind, reached FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) WHERE reached OR level = 1""",
)
def impact_of_models(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "file_path")
    seeds = n.where(F.col("kind") == "model").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return GR.impact(seeds, G.edges(s, d, "source", "target"), n, 2).select("seed", "level", "node", "kind", "reached")


@q(
    "paths_to_base",
    f"""WITH RECURSIVE {S.N}, {S.E}, {_STEP.format(S.quoted(D.PATH_KINDS))}, hub AS (SELECT target FROM e WHERE kind <> 'contains' GROUP BY target ORDER BY count(*) DESC, target LIMIT 1),
w AS (SELECT id AS source, id AS node, [id] AS path FROM n WHERE kind = 'view'
  UNION ALL SELECT w.source, s.dst, list_append(w.path, s.dst) FROM w JOIN step s ON s.src = w.node WHERE len(w.path) <= 6 AND NOT list_contains(w.path, s.dst)),
best AS (SELECT source, node, path FROM w QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY len(path), path) = 1)
SELECT source, node AS target, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, ' > ') AS path FROM best JOIN hub ON node = hub.target WHERE source <> node""",
)
def paths_to_base(s: SparkSession, d: str) -> DataFrame:
    """Shortest paths from every view to the most referenced symbol."""
    e = G.edges(s, d, "source", "target")
    hub = e.where(F.col("kind") != "contains").groupBy("target").count().orderBy(F.desc("count"), "target").limit(1).select("target")
    views = G.nodes(s, d, "name").where(F.col("kind") == "view").select(F.col("id").alias("source"))
    target = hub.first()
    if target is None:
        pairs = views.limit(0).withColumn("target", F.lit(""))
    else:
        pairs = views.withColumn("target", F.lit(target[0]))
    p = GR.shortest_paths(pairs, e)
    return p.select("source", "target", "hops", F.array_join("path", " > ").alias("path"))


@q("feature_slices")
def feature_slices(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "name", "file_path")
    seeds = n.where(F.col("kind") == "view").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return GR.feature(seeds, G.edges(s, d, "source", "target"), n).select("seed", "node", "level")


@q(
    "template_ancestry",
    f"""WITH RECURSIVE {S.N}, {S.E}, {_STEP.format("'renders', 'includes_template', 'extends_template'")},
w AS (SELECT id AS seed, id AS node, 0 AS depth FROM n WHERE kind = 'template' UNION SELECT w.seed, s.src, w.depth + 1 FROM w JOIN step s ON s.dst = w.node WHERE w.depth < 8)
SELECT seed AS template, node AS ancestor, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE node <> seed GROUP BY ALL""",
)
def template_ancestry(s: SparkSession, d: str) -> DataFrame:
    return GR.template_ancestry(G.edges(s, d, "source", "target"), G.nodes(s, d, "name"))


@q(
    "covering_tests",
    f"WITH {S.N}, {S.E} SELECT DISTINCT target AS symbol, source AS test FROM e JOIN n ON n.id = source WHERE {S.covering('e.kind', 'file_path')} AND target IS NOT NULL",
)
def covering_tests(s: SparkSession, d: str) -> DataFrame:
    src = G.nodes(s, d, "file_path").select(F.col("id").alias("source"), "file_path")
    e = G.edges(s, d, "source", "target").join(src, "source").where(P.is_covering("kind", "file_path") & F.col("target").isNotNull())
    return e.select(F.col("target").alias("symbol"), F.col("source").alias("test")).distinct()


# --- flows (J7-J10, D12, D16, C18, L3, L4) ------------------------------------------------------------------


def _decorated(words) -> str:
    return f"coalesce(regexp_matches(lower(decorators), '{'|'.join(words)}'), false)"


_ENTRIES = rf"""into_ AS (SELECT target AS id, kind FROM e WHERE source IN (SELECT id FROM n)),
entry AS (SELECT * FROM (SELECT id, CASE WHEN kind = 'route' THEN 'route'
  WHEN kind IN ('view', 'class', 'function') AND ({_decorated(D.DRF_DECORATORS)} OR coalesce(regexp_matches(signature, '{'|'.join(D.DRF_BASES)}'), false)) THEN 'drf_view'
  WHEN {S.command_path('file_path')} AND name IN ('Command', 'handle') THEN 'management_command' WHEN {_decorated(D.TASK_DECORATORS)} THEN 'celery_task'
  WHEN id IN (SELECT id FROM into_ WHERE kind = 'receives') OR {_decorated(D.RECEIVER_DECORATORS)} THEN 'signal_receiver' WHEN id IN (SELECT id FROM into_ WHERE kind = 'admin_of') THEN 'admin_action'
  WHEN name = 'ready' AND suffix(replace(file_path, '\', '/'), 'apps.py') THEN 'app_config_hook' WHEN kind = 'method' AND name IN ('save', 'delete', 'clean') THEN 'model_lifecycle'
  WHEN kind IN ('function', 'method', 'class', 'model', 'view') AND id NOT IN (SELECT id FROM into_ WHERE kind IN ({S.quoted(D.FLOW_KINDS)}) AND id IS NOT NULL) THEN 'true_root' END AS entry_kind
  FROM n WHERE NOT {S.generated_path('file_path')} AND NOT {S.test_path('file_path')}) WHERE entry_kind IS NOT NULL)"""

_TRACE = f"""fstep AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE kind IN ({S.quoted(D.FLOW_KINDS)}) AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)),
fw AS (SELECT id AS flow, id AS node, 0 AS depth FROM entry UNION SELECT w.flow, s.dst, w.depth + 1 FROM fw w JOIN fstep s ON s.src = w.node WHERE w.depth < 15),
member AS (SELECT flow, node, depth FROM (SELECT flow, node, CAST(min(depth) AS INTEGER) AS depth FROM fw GROUP BY flow, node) QUALIFY count(*) OVER (PARTITION BY flow) > 1)"""

_C = D.CRITICALITY
_FLOW_NAME = r"coalesce(nullif(string_split(n.qualified_name, '::')[-1], ''), n.name)"
_MEASURE = f"""cov AS (SELECT DISTINCT target AS id FROM e JOIN n ON n.id = source WHERE {S.covering('e.kind', 'n.file_path')}),
pend AS (SELECT from_node_id AS id, count(*) AS c FROM (SELECT DISTINCT * FROM unresolved_refs) GROUP BY ALL),
shape AS (SELECT flow, count(*) AS nodes, max(depth) AS depth_max, count(DISTINCT {S.app('x.file_path')}) AS apps, count(DISTINCT x.file_path) AS files,
  count(DISTINCT CASE WHEN x.project_id <> h.project_id THEN x.project_id END) AS projects, sum(CASE WHEN x.kind = 'external' THEN 1 ELSE 0 END + coalesce(pend.c, 0)) AS external,
  avg(CASE WHEN {S.sensitive('x.name', 'x.qualified_name')} THEN 1 ELSE 0 END) AS security, avg(CASE WHEN cov.id IS NULL THEN 1 ELSE 0 END) AS test_gap
  FROM member JOIN n x ON x.id = node JOIN n h ON h.id = flow LEFT JOIN cov ON cov.id = node LEFT JOIN pend ON pend.id = node GROUP BY flow),
flows AS (SELECT flow, {_FLOW_NAME} AS name, entry_kind, nodes, depth_max, apps, files, projects,
  (CASE entry_kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in D.ENTRY_WEIGHTS.items())} END) * {_C['entry']} + least(apps, 5) / 5.0 * {_C['apps']} + security * {_C['security']} + test_gap * {_C['test_gap']}
  + least(projects, 2) / 2.0 * {_C['projects']} + least(external, 5) / 5.0 * {_C['external']} + least(depth_max, 15) / 15.0 * {_C['depth']} AS criticality
  FROM shape JOIN entry ON entry.id = flow JOIN n ON n.id = flow)"""


def _flow_roles(s: SparkSession, d: str):
    n = G.nodes(s, d, "project_id", "name", "qualified_name", "file_path", "signature", "decorators")
    return n, G.edges(s, d, "source", "target"), G.refs(s, d)


@q("flow_entries", f"WITH {S.N}, {S.E}, {_ENTRIES} SELECT id, entry_kind FROM entry")
def flow_entries(s: SparkSession, d: str) -> DataFrame:
    n, e, _ = _flow_roles(s, d)
    return FL.entries(n, e)


@q(
    "flows",
    f"WITH RECURSIVE {S.N}, {S.E}, {_ENTRIES}, {_TRACE}, {_MEASURE} SELECT flow, name, entry_kind, nodes, depth_max, apps, files, projects, round(criticality, 6) AS criticality FROM flows",
)
def flows(s: SparkSession, d: str) -> DataFrame:
    f, _ = FL.compute(*_flow_roles(s, d))
    return f.select("flow", "name", "entry_kind", "nodes", "depth_max", "apps", "files", "projects", F.round("criticality", 6).alias("criticality"))


@q("flow_members", f"WITH RECURSIVE {S.N}, {S.E}, {_ENTRIES}, {_TRACE} SELECT flow, node, depth FROM member")
def flow_members(s: SparkSession, d: str) -> DataFrame:
    return FL.compute(*_flow_roles(s, d))[1].select("flow", "node", "depth")


@q(
    "flow_participation",
    f"""WITH RECURSIVE {S.N}, {S.E}, {_ENTRIES}, {_TRACE}, {_MEASURE},
p AS (SELECT node, name, criticality, row_number() OVER (PARTITION BY node ORDER BY criticality DESC, name, flow) AS r FROM member JOIN flows USING (flow))
SELECT node, round(sum(criticality), 6) AS total, count(*) AS flows FROM p WHERE r <= 64 GROUP BY node""",
)
def flow_participation(s: SparkSession, d: str) -> DataFrame:
    f, m = FL.compute(*_flow_roles(s, d))
    counted = m.groupBy("node").agg(F.least(F.count(F.lit(1)), F.lit(64).cast("long")).alias("flows"))
    return FL.participation(f, m).join(counted, "node").select("node", F.round("total", 6).alias("total"), "flows")


@q(
    "affected_flows",
    f"""WITH RECURSIVE {S.N}, {S.E}, {_ENTRIES}, {_TRACE}, {_HUNKS}, t AS (SELECT DISTINCT id FROM h JOIN n ON n.project_id = h.project_id AND n.file_path = h.file_path AND start_line <= h_end AND end_line >= h_start
  WHERE kind IN ('class', 'function', 'method', 'model', 'view')) SELECT DISTINCT flow FROM member WHERE node IN (SELECT id FROM t)""",
)
def affected_flows(s: SparkSession, d: str) -> DataFrame:
    f, m = FL.compute(*_flow_roles(s, d))
    touched = R.touched(hunks(s, d), G.nodes(s, d, "project_id", "file_path", "start_line", "end_line")).select(F.col("node_id").alias("node"))
    return FL.touching(f, m, touched).select("flow")


# --- risk and filter (L1, L2, D18) ----------------------------------------------------------------------------


_W = RK.weights(churn=False, flow=False)


@q(
    "changed_risk",
    f"""WITH {S.N}, {S.E}, {_HUNKS}, t AS (SELECT id, CAST(least(sum(least(end_line, h_end) - greatest(start_line, h_start) + 1), end_line - start_line + 1) AS BIGINT) AS diff
  FROM h JOIN n ON n.project_id = h.project_id AND n.file_path = h.file_path AND start_line <= h_end AND end_line >= h_start WHERE kind IN ('class', 'function', 'method', 'model', 'view') GROUP BY id, start_line, end_line),
p AS (SELECT target, e.kind, source, count(*) AS times FROM e WHERE kind <> 'contains' AND target IN (SELECT id FROM t) GROUP BY ALL),
x AS (SELECT t.id, count(*) AS callers, sum(CASE WHEN {S.covering('p.kind', 'c.file_path')} THEN times ELSE 0 END) AS covering, count(CASE WHEN {S.app('c.file_path')} <> {S.app('b.file_path')} THEN 1 END) AS cross_app,
  count(CASE WHEN c.project_id <> b.project_id THEN 1 END) AS cross_project FROM t JOIN n b ON b.id = t.id JOIN p ON p.target = t.id JOIN n c ON c.id = p.source GROUP BY t.id)
SELECT n.id, t.diff, coalesce(callers, 0) AS callers, round(least(coalesce(callers, 0), 20) / 20.0 * {_W['callers']} + least(coalesce(cross_app, 0), 5) / 5.0 * {_W['cross_app']} + least(coalesce(cross_project, 0), 2) / 2.0 * {_W['cross_project']}
  + least(t.diff, 100) / 100.0 * {_W['diff']} + CASE WHEN NOT {S.test_path('n.file_path')} AND {S.sensitive('n.name', 'n.qualified_name')} THEN {_W['security']} ELSE 0 END
  + (1 - CASE WHEN {S.test_path('n.file_path')} THEN 1.0 ELSE least(coalesce(covering, 0), 5) / 5.0 END) * {_W['test_gap']}, 6) AS risk
FROM t JOIN n USING (id) LEFT JOIN x USING (id) ORDER BY risk DESC, callers DESC, n.file_path, n.start_line, n.id LIMIT 100000""",
)
def changed_risk(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "project_id", "name", "qualified_name", "file_path", "start_line", "end_line")
    t = R.touched(hunks(s, d), n)
    c = RK.changed(t, n, G.edges(s, d, "source", "target"), None, None, 100_000)
    return c.select("id", "diff", "callers", F.round("risk", 6).alias("risk"))


_CALLERS = "cl AS (SELECT target AS id, count(DISTINCT source) AS callers FROM e WHERE kind <> 'contains' AND source IN (SELECT id FROM n) GROUP BY target)"


@q(
    "winnow_hot_functions",
    f"""WITH {S.N}, {S.E}, {_CALLERS} SELECT id, coalesce(callers, 0) AS callers, end_line - start_line + 1 AS lines FROM n LEFT JOIN cl USING (id)
WHERE kind IN ('function', 'method') AND language = 'python' AND end_line - start_line + 1 >= 5 AND (contains(lower(name), 'order') OR contains(lower(name), 'token')) AND coalesce(callers, 0) > 0""",
)
def winnow_hot_functions(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "project_id", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "decorators")
    w = winnow(n, G.edges(s, d, "source", "target"), [("kind", "in", "function,method"), ("callers", ">", "0"), ("language", "eq", "python"), ("lines", ">=", "5"), ("name", "contains", "order,token")], "callers", None)
    return w.select("id", "callers", "lines")


@q(
    "winnow_untested_risk",
    f"""WITH {S.N}, {S.E}, {_CALLERS}, cov AS (SELECT DISTINCT target AS id FROM e JOIN n ON n.id = source WHERE {S.covering('e.kind', 'n.file_path')}),
x AS (SELECT n.id, least(coalesce(callers, 0), 20) / 20.0 * 0.05 + CASE WHEN {S.sensitive('name', 'qualified_name')} THEN 0.15 ELSE 0 END + 0.25 AS risk FROM n LEFT JOIN cl ON cl.id = n.id
  WHERE n.id NOT IN (SELECT id FROM cov WHERE id IS NOT NULL) AND NOT {S.test_path('file_path')} AND n.kind IN ('model', 'class', 'view'))
SELECT id, round(risk, 6) AS risk FROM x WHERE risk >= 0.3""",
)
def winnow_untested_risk(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "project_id", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "decorators")
    w = winnow(n, G.edges(s, d, "source", "target"), [("tested", "eq", "false"), ("kind", "in", "model,class,view"), ("risk", "gte", "0.3")], "risk", None)
    return w.select("id", F.round("risk", 6).alias("risk"))


@q(
    "winnow_extends",
    f"""WITH {S.N}, {S.E} SELECT id, name FROM n WHERE lower(file_path) LIKE '%/m_dels.py' AND id IN (SELECT source FROM e JOIN n t ON t.id = target WHERE e.kind = 'extends' AND contains(lower(t.name), 'record'))
AND id IN (SELECT target FROM e JOIN n b ON b.id = source WHERE e.kind <> 'contains' AND contains(lower(b.name), 'a'))""",
)
def winnow_extends(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "project_id", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "decorators")
    w = winnow(n, G.edges(s, d, "source", "target"), [("extends", "contains", "record"), ("called_by", "contains", "a"), ("file", "matches", "*/m?dels.py")], "name", None)
    return w.select("id", "name")


@q(
    "churn_recency",
    f"""WITH {S.COMMITS}, c AS (SELECT file_path, count(DISTINCT commit_hash) AS commits, max(committed_at) AS latest FROM commits JOIN commit_files USING (project_id, commit_hash) WHERE committed_at >= {SINCE} GROUP BY ALL),
m AS (SELECT max(latest) AS now FROM c), r AS (SELECT file_path, commits, CASE WHEN (now - latest) / 86400.0 > 7 THEN 0 ELSE exp(-0.231 * ((now - latest) / 86400.0)) END AS recency FROM c, m)
SELECT file_path, round(recency, 6) AS recency, CAST(round((SELECT median(commits) FROM c) * 0.25 * 0.2 * recency) AS BIGINT) AS bonus FROM r""",
)
def churn_recency(s: SparkSession, d: str) -> DataFrame:
    c = T.churn(G.commits(s, d), G.commit_files(s, d), SINCE)
    now = c.agg(F.max("latest")).scalar()
    median = c.agg(F.percentile("commits", F.lit(0.5))).scalar()
    r = c.withColumn("recency", P.commit_recency((now - F.col("latest")) / 86400.0))
    total = P.file_recency(F.lit(0.0), F.lit(0.0), "recency")
    return r.select("file_path", F.round("recency", 6).alias("recency"), P.recency_bonus(median, total).alias("bonus"))


# --- search and ranking (I1-I11, D17) -----------------------------------------------------------------------------


TERMS = ["voucher", "lookup", "ambiguous", "template"]


@q(
    "search_documents",
    f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL), z AS (SELECT doc_id, sum(tf) AS size FROM p GROUP BY ALL), a AS (SELECT count(*) AS n, avg(size) AS mean FROM z),
h AS (SELECT * FROM p JOIN z USING (doc_id) WHERE term IN ({S.quoted(TERMS)})), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, count(*) AS matched, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM h JOIN f USING (term), a GROUP BY doc_id""",
)
def search_documents(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").where(F.col("text").isNotNull())
    return SE.bm25(docs, ["doc_id"], "text", TERMS).select("doc_id", "matched", F.round("score", 6).alias("score"))


@q("search_fuzzy", f"WITH {S.N} SELECT id, name FROM n WHERE kind IN ({S.quoted(D.DEFINITION_KINDS)}) AND length(name) <= 17 AND regexp_matches(lower(name), 't.*k.*v.*w') ORDER BY length(name), id")
def search_fuzzy(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "name", "file_path", "start_line").where(F.length("name") <= 17)
    return SE.fuzzy(n, "tkvw").select("id", "name")


WORDS = ["order", "token", "voucher_rows", "session"]
_HAS = [f"max(CASE WHEN contains(lower(name), '{w}') OR contains(lower(base), '{w}') THEN 1 ELSE 0 END) AS has{i}, max(CASE WHEN lower(name) = '{w}' THEN 1 ELSE 0 END) AS is{i}" for i, w in enumerate(WORDS)]


@q(
    "file_ranking",
    rf"""WITH {S.N}, b AS (SELECT project_id, file_path, name, regexp_extract(file_path, '([^/\\]*)$', 1) AS base FROM n WHERE file_path IS NOT NULL),
f AS (SELECT project_id, file_path, max(CASE WHEN contains(lower(file_path), 'voucher_rows') THEN 1 ELSE 0 END) AS path_coverage,
  max({' + '.join(f"CASE WHEN contains(lower(name), '{w}') THEN 1 ELSE 0 END" for w in WORDS)}) AS name_coverage, {', '.join(_HAS)} FROM b GROUP BY ALL),
t AS (SELECT count(*) AS n, {', '.join(f'greatest(sum(has{i}), 1) AS df{i}' for i in range(len(WORDS)))} FROM f)
SELECT project_id, file_path, path_coverage, name_coverage, {' + '.join(f'is{i}' for i in range(len(WORDS)))} AS exact_names,
  CAST({' + '.join(f'CASE WHEN has{i} = 1 THEN floor(n * 1000 / df{i}) ELSE 0 END' for i in range(len(WORDS)))} AS BIGINT) AS weighted FROM f, t WHERE weighted > 0 OR path_coverage > 0""",
)
def file_ranking(s: SparkSession, d: str) -> DataFrame:
    r = SE.file_ranking(G.nodes(s, d, "project_id", "name", "file_path"), " ".join(WORDS))
    return r.select("project_id", "file_path", "path_coverage", "name_coverage", "exact_names", "weighted")


@q(
    "document_frequencies",
    rf"""WITH {S.N}, b AS (SELECT project_id, file_path, lower(name) AS name, lower(regexp_extract(file_path, '([^/\\]*)$', 1)) AS base FROM n), w AS (SELECT unnest([{S.quoted(WORDS)}]) AS term)
SELECT term, count(DISTINCT (project_id, file_path)) AS files FROM b, w WHERE contains(name, term) OR contains(base, term) GROUP BY term""",
)
def document_frequencies(s: SparkSession, d: str) -> DataFrame:
    return SE.document_frequencies(G.nodes(s, d, "project_id", "name", "file_path"), " ".join(WORDS))


def _walk_sql(rounds: int = 20) -> str:
    steps = ", ".join(
        f"r{i} AS MATERIALIZED (SELECT id, sum(rank) AS rank FROM (SELECT b AS id, rank * 0.85 * w / deg AS rank FROM r{i - 1} JOIN pairs ON a = id JOIN degree USING (a) UNION ALL SELECT id, 0.15 / c FROM seeds, total) GROUP BY id)"
        for i in range(1, rounds + 1)
    )
    return f"""WITH {S.N}, {S.E}, both_ AS (SELECT source AS a, target AS b FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) UNION ALL SELECT target, source FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)),
pairs AS MATERIALIZED (SELECT a, b, count(*) AS w FROM both_ GROUP BY ALL), degree AS MATERIALIZED (SELECT a, sum(w) AS deg FROM pairs GROUP BY a), seeds AS (SELECT id FROM n WHERE kind = 'view'), total AS (SELECT count(*) AS c FROM seeds),
r0 AS MATERIALIZED (SELECT id, 1.0 / c AS rank FROM seeds, total), {steps} SELECT id, round(rank, 9) AS rank FROM r{rounds} WHERE rank > 0"""


@q("restart_walk", _walk_sql())
def restart_walk(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "name")
    w = GR.restart_walk(n.where(F.col("kind") == "view").select("id"), G.edges(s, d, "source", "target"), n)
    return w.select("id", F.round("rank", 9).alias("rank"))


@q("explore")
def explore(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "project_id", "name", "qualified_name", "file_path", "start_line", "docstring", "signature")
    return SE.explore(n, G.edges(s, d, "source", "target"), G.content(s, d), "where does the voucher session get resolved", 20)


# --- resolution (K1-K18) ---------------------------------------------------------------------------------------------


_PREF = "CASE reference_kind " + " ".join(f"WHEN '{k}' THEN [{S.quoted(v)}]" for k, v in D.PREFERRED_KINDS.items() if k) + f" ELSE [{S.quoted(D.PREFERRED_KINDS[''])}] END"
_DIR = r"list_filter(string_split(regexp_replace(regexp_replace({}, '[^/\\]*$', ''), '\\', '/', 'g'), '/'), lambda x: x <> '')"


@q(
    "resolve_by_locality",
    rf"""WITH {S.N}, {S.R}, c AS (SELECT ref_id, n.id AS target, list_contains({_PREF}, n.kind) AS preferred, n.kind, reference_kind, {_DIR.format("coalesce(r.file_path, '')")} AS a, {_DIR.format('n.file_path')} AS b
  FROM r JOIN n ON n.project_id = r.project_id AND n.name = r.reference_name WHERE n.kind NOT IN ('import', 'external') AND reference_kind IS NOT NULL),
p AS (SELECT ref_id, target, count(*) OVER (PARTITION BY ref_id) AS k, len(list_filter(range(1, 65), lambda i: i <= least(len(a), len(b)) AND a[1:i] = b[1:i])) AS depth FROM c WHERE preferred),
x AS (SELECT ref_id, target, CASE WHEN k = 1 THEN 0.9 ELSE 0.6 END AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY depth DESC, target) = 1),
l AS (SELECT ref_id, any_value(target) AS target, 0.6 AS confidence FROM c GROUP BY ref_id HAVING count(*) = 1 AND NOT bool_or(preferred) AND NOT bool_or(reference_kind IN ({S.quoted(D.STRICT_KINDS)})) AND NOT bool_or(kind IN ({S.quoted(D.LOOSE_BARRED)})))
SELECT ref_id, target, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT * FROM x UNION ALL SELECT * FROM l)""",
)
def resolve_by_locality(s: SparkSession, d: str) -> DataFrame:
    r = RES.by_locality(G.refs(s, d), G.nodes(s, d, "project_id", "name", "file_path"))
    return r.select("ref_id", "target", "confidence")


@q("resolve_references")
def resolve_references(s: SparkSession, d: str) -> DataFrame:
    """All strategies together; marks and candidates come from the packed field."""
    n = G.nodes(s, d, "project_id", "name", "qualified_name", "file_path", "language")
    return RES.resolve(G.refs(s, d), G.ref_candidates(s, d), n, RES.import_mappings(G.content(s, d)))


_LINK_KINDS = {"relates_to": ("model",), "instantiates": ("class", "model"), "handles": ("function", "method"), "extends": ("class", "model")}


@q(
    "link_names",
    " UNION ALL ".join(
        f"""(WITH {S.N}, {S.R}, m AS (SELECT ref_id, count(*) AS c, min(n.id) AS target FROM r JOIN n ON n.name = r.reference_name AND n.project_id <> r.project_id AND n.kind IN ({S.quoted(v)})
WHERE reference_kind = '{k}' GROUP BY ref_id) SELECT ref_id, target, CAST(0.8 AS DOUBLE) AS confidence, 'link-{k}' AS strategy FROM m WHERE c = 1)"""
        for k, v in _LINK_KINDS.items()
    ),
)
def link_names(s: SparkSession, d: str) -> DataFrame:
    return RES.link_names(G.refs(s, d), G.nodes(s, d, "project_id", "name"), _LINK_KINDS)


@q(
    "inherited_calls",
    f"""WITH RECURSIVE {S.N}, {S.E}, {S.R}, {_UP}, {_OWNED}, a AS (SELECT sub AS cls, name, depth, count(DISTINCT method) AS c, min(method) AS method FROM sup JOIN o ON o.cls = sup.base WHERE depth > 0 GROUP BY ALL),
i AS (SELECT cls, name, method FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY cls, name ORDER BY depth) = 1) WHERE c = 1),
w AS (SELECT target AS id, min(source) AS cls FROM e WHERE kind = 'contains' GROUP BY target)
SELECT ref_id, method AS target FROM r JOIN w ON w.id = from_node_id JOIN i ON i.cls = w.cls AND i.name = reference_name WHERE reference_kind = 'calls'""",
)
def inherited_calls(s: SparkSession, d: str) -> DataFrame:
    n, e = G.nodes(s, d, "name"), G.edges(s, d, "source", "target")
    return RES.inherited_calls(G.refs(s, d), e, n, GR.inherited_methods(e, n)).select("ref_id", "target")


# --- mutations (B1-B10, A17, M9) ----------------------------------------------------------------------------------------


_GONE = "gone AS (SELECT DISTINCT project_id, path AS file_path FROM files EXCEPT SELECT DISTINCT project_id, path FROM file_scan)"


def _gone(s: SparkSession, d: str) -> DataFrame:
    return M.missing_files(read(s, d, "files"), read(s, d, "file_scan")).select("project_id", F.col("path").alias("file_path"))


@q(
    "after_removal",
    f"""WITH {S.N}, {S.E}, {_GONE}, dead AS (SELECT id FROM n JOIN gone USING (project_id, file_path))
SELECT edge_id, source, target FROM e WHERE coalesce(source NOT IN (SELECT id FROM dead), true) AND coalesce(target NOT IN (SELECT id FROM dead), true)""",
)
def after_removal(s: SparkSession, d: str) -> DataFrame:
    """The edges that survive when files the walk no longer sees are removed."""
    n = G.nodes(s, d, "project_id", "file_path")
    e = M.remove_files(n, G.edges(s, d, "source", "target"), G.refs(s, d), _gone(s, d))[1]
    return e.select("edge_id", "source", "target")


@q(
    "stale_files",
    """WITH o AS (SELECT project_id, path, lower(content_hash) AS h FROM files QUALIFY row_number() OVER (PARTITION BY project_id, path ORDER BY indexed_at DESC, h DESC NULLS LAST) = 1),
c AS (SELECT project_id, path, lower(content_hash) AS h FROM file_scan QUALIFY row_number() OVER (PARTITION BY project_id, path ORDER BY observed_at DESC, h DESC NULLS LAST) = 1)
SELECT coalesce(o.project_id, c.project_id) AS project_id, coalesce(o.path, c.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN c ON o.project_id = c.project_id AND o.path = c.path WHERE o.path IS NULL OR c.path IS NULL OR o.h IS DISTINCT FROM c.h""",
)
def stale_files(s: SparkSession, d: str) -> DataFrame:
    old = read(s, d, "files").withColumn("h", F.lower("content_hash"))
    new = read(s, d, "file_scan").withColumn("h", F.lower("content_hash"))
    diff = manifest_diff(old, new, ["project_id", "path"], "indexed_at", "observed_at", "h")
    return diff.where(F.col("change") != "same").select("project_id", "path", "change")


@q(
    "after_unify",
    f"""WITH {S.N}, {S.E}, redirect AS (SELECT x.id AS stub, min(y.id) AS target FROM n x JOIN n y ON y.name = x.name AND y.kind IN ('class', 'model') WHERE x.kind = 'external' GROUP BY x.id HAVING count(*) = 1)
SELECT edge_id, source, coalesce(redirect.target, e.target) AS target FROM e LEFT JOIN redirect ON stub = e.target""",
)
def after_unify(s: SparkSession, d: str) -> DataFrame:
    """Edges led from stubs to the only class of their name."""
    n = G.nodes(s, d, "name")
    only = n.where(F.col("kind").isin("class", "model")).groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("target")).where(F.col("c") == 1)
    to = n.where(F.col("kind") == "external").select(F.col("id").alias("stub"), "name").join(only, "name").select("stub", "target")
    return M.unify_externals(n, G.edges(s, d, "source", "target"), to)[1].select("edge_id", "source", "target")


@q(
    "still_pending",
    f"""WITH {S.N}, {S.E}, {S.R} SELECT ref_id FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = r.from_node_id AND e.kind = r.reference_kind AND e.line = r.line AND e.col = r.col)
AND NOT EXISTS (SELECT 1 FROM e JOIN n ON n.id = e.target WHERE e.source = r.from_node_id AND e.kind = r.reference_kind AND n.kind IN ('template', 'external') AND n.name = r.reference_name)""",
)
def still_pending(s: SparkSession, d: str) -> DataFrame:
    r = M.drop_satisfied(G.refs(s, d), G.edges(s, d, "source", "target", "line", "col"), G.nodes(s, d, "name"))
    return r.select("ref_id")


@q(
    "after_project_delete",
    f"WITH {S.E} SELECT edge_id FROM e WHERE NOT coalesce(starts_with(source, 'tidewater::'), false) AND NOT coalesce(starts_with(target, 'tidewater::'), false)",
)
def after_project_delete(s: SparkSession, d: str) -> DataFrame:
    return M.delete_project("tidewater", G.nodes(s, d, "project_id"), G.edges(s, d, "source", "target"))[1].select("edge_id")


@q(
    "after_synthesis",
    f"""WITH {S.E}, fwd AS (SELECT DISTINCT source, target FROM e WHERE kind = 'relates_to' AND (provenance IS NULL OR NOT starts_with(provenance, 'synthesis:reverse')) AND source <> target AND {S.project('source')} = {S.project('target')})
SELECT kind, provenance, count(*) AS edges FROM (SELECT kind, provenance FROM e WHERE NOT (coalesce(starts_with(provenance, 'synthesis:reverse'), false) AND starts_with(source, 'tidewater::'))
UNION ALL SELECT 'relates_to', 'synthesis:reverse' FROM fwd a WHERE starts_with(a.target, 'tidewater::') AND NOT EXISTS (SELECT 1 FROM fwd b WHERE b.source = a.target AND b.target = a.source)) GROUP BY ALL""",
)
def after_synthesis(s: SparkSession, d: str) -> DataFrame:
    e = G.edges(s, d, "source", "target", "provenance")
    fresh = R.reverse_relations(e).where(F.startswith("source", F.lit("tidewater::"))).select("source", "target", F.lit("relates_to").alias("kind"), F.lit("synthesis:reverse").alias("provenance"))
    return M.replace_synthesized(e, "tidewater", "synthesis:reverse", fresh).groupBy("kind", "provenance").agg(F.count(F.lit(1)).alias("edges"))


# --- extraction (A2-A6, N1) ------------------------------------------------------------------------------------------------


@q("extract_records")
def extract_records(s: SparkSession, d: str) -> DataFrame:
    """All source files through their extractors: records per kind."""
    from .. import extraction as X

    return X.extract(G.content(s, d)).groupBy("language", "record", "kind").agg(F.count(F.lit(1)).alias("records"))


@q("extract_nodes")
def extract_nodes(s: SparkSession, d: str) -> DataFrame:
    from .. import extraction as X

    n = X.tables(X.extract(G.content(s, d)))["nodes"]
    return n.select("id", "kind", "name", "file_path", "start_line", "end_line", "signature").distinct()


@q(
    "css_selectors",
    r"""WITH c AS (SELECT DISTINCT project_id, file_path, content FROM file_content WHERE suffix(lower(file_path), '.css')),
b AS (SELECT project_id, file_path, regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', '', 'g'), '"[^"\n]*"', '', 'g') AS t FROM c),
h AS (SELECT project_id, file_path, unnest(regexp_extract_all(t, '([^{}]*)\{', 1)) AS head FROM b),
n AS (SELECT DISTINCT project_id, file_path, unnest(regexp_extract_all(head, '[.#]-?[A-Za-z_][\w-]*')) AS selector FROM h WHERE NOT starts_with(trim(head, E' \n\r\t'), '@'))
SELECT project_id, file_path, selector FROM n""",
)
def css_selectors(s: SparkSession, d: str) -> DataFrame:
    """Selectors of style sheets in the JVM alone (the extractor's rule as expressions)."""
    c = G.content(s, d).where(F.lower("file_path").endswith(".css"))
    t = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r'"[^"\n]*"', "")
    heads = c.select("project_id", "file_path", F.explode(F.regexp_extract_all(t, F.lit(r"([^{}]*)\{"), F.lit(1))).alias("head"))
    heads = heads.where(~F.startswith(F.regexp_replace("head", r"^\s+", ""), F.lit("@")))
    names = F.explode(F.regexp_extract_all("head", F.lit(r"([.#]-?[A-Za-z_][\w-]*)"), F.lit(1)))
    return heads.select("project_id", "file_path", names.alias("selector")).distinct()


# --- further reads (C12, D5, K10, L6, L11, L14) ---------------------------------------------------------------------------------


@q("reverse_targets", f"WITH {S.E} SELECT DISTINCT source, target FROM e WHERE kind = 'relates_to' AND starts_with(provenance, 'synthesis:reverse')")
def reverse_targets(s: SparkSession, d: str) -> DataFrame:
    e = G.edges(s, d, "source", "target", "provenance")
    return e.where((F.col("kind") == "relates_to") & F.col("provenance").startswith("synthesis:reverse")).select("source", "target").distinct()


@q("flow_edge_counts", f"WITH {S.E} SELECT source, count(*) AS edges FROM e WHERE kind IN ({S.quoted(D.FLOW_KINDS)}) GROUP BY source")
def flow_edge_counts(s: SparkSession, d: str) -> DataFrame:
    return G.edges(s, d, "source").where(F.col("kind").isin(*D.FLOW_KINDS)).groupBy("source").agg(F.count(F.lit(1)).alias("edges"))


@q(
    "handlers",
    f"""WITH {S.E}, a AS (SELECT source AS route, min(target) AS view FROM e WHERE kind = 'routes_to' GROUP BY source), b AS (SELECT source AS view, min(target) AS template FROM e WHERE kind = 'renders' GROUP BY source)
SELECT route, view, template FROM a LEFT JOIN b USING (view)""",
)
def handlers(s: SparkSession, d: str) -> DataFrame:
    """What each routing symbol leads to: its first handler and that one's first template."""
    e = G.edges(s, d, "source", "target")
    first = lambda kind, a, b: e.where(F.col("kind") == kind).groupBy(F.col("source").alias(a)).agg(F.min("target").alias(b))
    return first("routes_to", "route", "view").join(first("renders", "view", "template"), "view", "left").select("route", "view", "template")


@q("symbol_history", f"WITH {S.CHANGES} SELECT qualified_name, commit_hash, change_kind FROM changes WHERE change_kind IS NOT NULL AND (qualified_name = 'purchase' OR suffix(qualified_name, '.purchase') OR suffix(qualified_name, '::purchase'))")
def symbol_history(s: SparkSession, d: str) -> DataFrame:
    return T.symbol_history(T.symbol_changes(G.revisions(s, d)), "purchase").select("qualified_name", "commit_hash", "change_kind")


@q(
    "resolve_by_convention",
    f"""WITH {S.N}, {S.R}, x AS (SELECT ref_id, project_id, reference_name AS name, CASE WHEN regexp_matches(reference_name, '(View|ViewSet)$') THEN 0 WHEN regexp_matches(reference_name, 'Form$') THEN 1 WHEN regexp_matches(reference_name, 'Model$|^[A-Z][a-z]+$') THEN 2 END AS rule
  FROM r WHERE lower(language) IN ('py', 'python')),
c AS (SELECT ref_id, n.id, CASE rule WHEN 0 THEN regexp_matches(file_path, 'views|/api/') WHEN 1 THEN regexp_matches(file_path, 'forms') ELSE regexp_matches(file_path, 'models') END AS placed FROM x JOIN n USING (project_id, name)
  WHERE (rule = 0 AND n.kind IN ('class', 'function', 'view')) OR (rule = 1 AND n.kind = 'class') OR (rule = 2 AND n.kind IN ('class', 'model')))
SELECT ref_id, target FROM (SELECT ref_id, CASE WHEN count(*) = 1 THEN min(id) ELSE min(CASE WHEN placed THEN id END) END AS target FROM c GROUP BY ref_id) WHERE target IS NOT NULL""",
)
def resolve_by_convention(s: SparkSession, d: str) -> DataFrame:
    return RES.conventions(G.refs(s, d), G.nodes(s, d, "project_id", "name", "file_path")).select("ref_id", "target")


@q("resolve_scoped_calls")
def resolve_scoped_calls(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "project_id", "name", "qualified_name", "file_path")
    return RES.scoped_calls(G.refs(s, d), n, RES.import_mappings(G.content(s, d)))
