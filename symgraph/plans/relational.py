"""Queries of the relational reads and of history, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P
from ..operators import reads as R
from ..operators import temporal as T
from ..sources import graph as G
from ..sources.tables import read
from . import sqltext as S
from .registry import Registry

registry = Registry()
q = registry.query

#: Callers and callees listed of one symbol.
LISTED = 40
#: 1998-01-01 and 2024-01-15 as epoch seconds.
SINCE = 883_612_800
AT = 1_705_276_800


# --- scans and dimensions (A12-A15) ------------------------------------------------------------


@q("nodes_valid", f"WITH {S.N} SELECT id, project_id, kind, name, file_path, start_line FROM n")
def nodes_valid(s: SparkSession, d: str) -> DataFrame:
    return G.nodes(s, d, "project_id", "name", "file_path", "start_line").select("id", "project_id", "kind", "name", "file_path", "start_line")


@q("edges_valid", f"WITH {S.E} SELECT edge_id, source, target, kind FROM e")
def edges_valid(s: SparkSession, d: str) -> DataFrame:
    return G.edges(s, d, "source", "target").select("edge_id", "source", "target", "kind")


@q(
    "files_with_counts",
    f"""WITH {S.N}, c AS (SELECT project_id, file_path, count(*) AS c FROM n GROUP BY ALL)
SELECT f.project_id, f.path, coalesce(c, 0) AS nodes FROM (SELECT DISTINCT project_id, path FROM files) f
LEFT JOIN c ON c.project_id = f.project_id AND c.file_path = f.path""",
)
def files_with_counts(s: SparkSession, d: str) -> DataFrame:
    counts = G.nodes(s, d, "project_id", "file_path").groupBy("project_id", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("c"))
    f = read(s, d, "files").select("project_id", "path").distinct()
    return f.join(counts, ["project_id", "path"], "left").select("project_id", "path", F.coalesce("c", F.lit(0)).alias("nodes"))


@q("file_states", f"WITH {S.FILES} SELECT project_id, path, content_hash, indexed_at FROM f")
def file_states(s: SparkSession, d: str) -> DataFrame:
    return G.files(s, d).select("project_id", "path", "content_hash", "indexed_at")


@q(
    "projects_by_version",
    "SELECT index_version, reference_only, count(*) AS projects FROM (SELECT DISTINCT * FROM projects) GROUP BY ALL",
)
def projects_by_version(s: SparkSession, d: str) -> DataFrame:
    return G.projects(s, d).groupBy("index_version", "reference_only").agg(F.count(F.lit(1)).alias("projects"))


@q(
    "find_project",
    "SELECT DISTINCT asked, id FROM (SELECT DISTINCT project_id AS asked FROM files UNION SELECT name FROM projects) JOIN projects ON asked = id OR asked = name",
)
def find_project(s: SparkSession, d: str) -> DataFrame:
    """Ids and display names to projects: two equality joins instead of one with OR."""
    p = G.projects(s, d).select("id", "name")
    asked = read(s, d, "files").select(F.col("project_id").alias("asked")).union(p.select("name")).distinct()
    by_id = asked.join(p, asked["asked"] == p["id"]).select("asked", "id")
    return by_id.union(asked.join(p, asked["asked"] == p["name"]).select("asked", "id")).distinct()


# --- counts and histograms (D1, D3, D13, D15, A18) ------------------------------------------------


@q("kind_counts", f"WITH {S.N} SELECT project_id, kind, count(*) AS symbols FROM n GROUP BY ALL")
def kind_counts(s: SparkSession, d: str) -> DataFrame:
    return G.nodes(s, d, "project_id").groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("symbols"))


@q(
    "scalar_counts",
    f"""WITH {S.N}, {S.E}, {S.R} SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e
UNION ALL SELECT 'links', count(*) FROM e WHERE {S.project('source')} <> {S.project('target')} UNION ALL SELECT 'refs', count(*) FROM r
UNION ALL SELECT 'files', count(*) FROM (SELECT DISTINCT project_id, path FROM files)""",
)
def scalar_counts(s: SparkSession, d: str) -> DataFrame:
    e = G.edges(s, d, "source", "target")
    parts = [
        ("nodes", G.nodes(s, d, "name")),
        ("edges", e),
        ("links", R.cross_project(e)),
        ("refs", G.refs(s, d)),
        ("files", read(s, d, "files").select("project_id", "path").distinct()),
    ]
    one = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, df in parts]
    out = one[0]
    for x in one[1:]:
        out = out.union(x)
    return out


@q(
    "directory_rollup",
    rf"""WITH {S.N}, p AS (SELECT project_id, file_path, string_split(replace(file_path, '\', '/'), '/') AS seg FROM n)
SELECT project_id, CASE WHEN len(seg) <= 1 THEN '(root)' ELSE array_to_string(seg[1:least(len(seg) - 1, 2)], '/') END AS directory,
  count(*) AS symbols, count(DISTINCT file_path) AS files FROM p GROUP BY ALL""",
)
def directory_rollup(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "project_id", "file_path").where(F.col("file_path").isNotNull())
    per_file = n.groupBy("project_id", "file_path").agg(F.count(F.lit(1)).alias("c"))
    return per_file.groupBy("project_id", P.directory_at("file_path", 2).alias("directory")).agg(F.sum("c").alias("symbols"), F.count(F.lit(1)).alias("files"))


@q("edge_breakdown", f"WITH {S.E} SELECT target, string_agg(c || ' ' || kind, ', ' ORDER BY c DESC, kind) AS breakdown FROM (SELECT target, kind, count(*) AS c FROM e WHERE kind <> 'contains' AND target IS NOT NULL GROUP BY ALL) GROUP BY target")
def edge_breakdown(s: SparkSession, d: str) -> DataFrame:
    """Incoming edge kinds of each symbol as text; at most one element per kind."""
    c = G.edges(s, d, "target").where((F.col("kind") != "contains") & F.col("target").isNotNull()).groupBy("target", "kind").agg(F.count(F.lit(1)).alias("c"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), "kind", F.concat_ws(" ", F.col("c").cast("string"), "kind").alias("t"))))
    return c.groupBy("target").agg(F.array_join(F.transform(parts, lambda x: x["t"]), ", ").alias("breakdown"))


@q(
    "base_combinations",
    f"""WITH {S.E}, b AS (SELECT source, string_agg(base, '+' ORDER BY base) AS bases FROM (SELECT DISTINCT source, regexp_extract(target, '([^.:]*)$', 1) AS base FROM e WHERE kind = 'extends') GROUP BY source)
SELECT bases, count(*) AS classes FROM b GROUP BY bases""",
)
def base_combinations(s: SparkSession, d: str) -> DataFrame:
    """Corpus survey: how often each set of base classes occurs."""
    x = G.edges(s, d, "source", "target").where(F.col("kind") == "extends")
    x = x.select("source", F.regexp_extract("target", r"([^.:]*)$", 1).alias("base")).distinct()
    return x.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("base")), "+").alias("bases")).groupBy("bases").agg(F.count(F.lit(1)).alias("classes"))


@q("field_types", f"WITH {S.N} SELECT split_part(signature, '(', 1) AS type, count(*) AS fields FROM n WHERE kind = 'field' AND contains(signature, '(') GROUP BY ALL")
def field_types(s: SparkSession, d: str) -> DataFrame:
    f = G.nodes(s, d, "signature").where((F.col("kind") == "field") & F.col("signature").contains("("))
    return f.groupBy(F.substring_index("signature", "(", 1).alias("type")).agg(F.count(F.lit(1)).alias("fields"))


# --- callers, callees, references (C7-C12, C17, D10, D11, D14, F1) ---------------------------------


def _ranked_sql(symbol: str, other: str) -> str:
    return f"""WITH {S.N}, {S.E}, p AS (SELECT {symbol} AS symbol, kind, {other} AS other, count(*) AS times FROM e GROUP BY ALL)
SELECT symbol, p.kind, other, times, CAST(row_number() OVER (PARTITION BY symbol ORDER BY {S.edge_rank('p.kind')}, CASE WHEN n.project_id = {S.project('symbol')} THEN 1 ELSE 0 END,
  {S.kind_rank('n.kind')}, {S.penalty('n.file_path')}, n.file_path NULLS FIRST, n.start_line NULLS FIRST, other, p.kind) AS INTEGER) AS position
FROM p JOIN n ON n.id = other WHERE symbol IS NOT NULL QUALIFY position <= {LISTED}"""


def _ranked(s: SparkSession, d: str, side: str) -> DataFrame:
    n = G.nodes(s, d, "project_id", "name", "file_path", "start_line")
    pairs = R.related(G.edges(s, d, "source", "target"), n, side).where(F.col("symbol").isNotNull())
    return R.ranked(pairs, LISTED).select("symbol", "kind", "other", "times", "position")


@q("callers", _ranked_sql("target", "source"))
def callers(s: SparkSession, d: str) -> DataFrame:
    return _ranked(s, d, "source")


@q("callees", _ranked_sql("source", "target"))
def callees(s: SparkSession, d: str) -> DataFrame:
    return _ranked(s, d, "target")


@q(
    "callers_located",
    f"WITH {S.N}, {S.E} SELECT edge_id, target, source, e.kind, name AS source_name, coalesce(line, 0) AS call_line FROM e JOIN n ON n.id = source WHERE e.kind <> 'contains'",
)
def callers_located(s: SparkSession, d: str) -> DataFrame:
    x = R.callers_located(G.edges(s, d, "source", "target", "line"), G.nodes(s, d, "name", "file_path"))
    return x.select("edge_id", "target", "source", "kind", "source_name", "call_line")


@q(
    "incoming_of_views",
    f"WITH {S.N}, {S.E} SELECT edge_id, e.kind, source, target FROM e WHERE target IN (SELECT id FROM n WHERE kind = 'view') AND source IN (SELECT id FROM n)",
)
def incoming_of_views(s: SparkSession, d: str) -> DataFrame:
    """Bulk references of a set of symbols by semi-joins (no chunks of ids)."""
    n = G.nodes(s, d, "name")
    e = G.edges(s, d, "source", "target")
    views = n.where(F.col("kind") == "view").select(F.col("id").alias("target"))
    return e.join(views, "target", "left_semi").join(n.select(F.col("id").alias("source")), "source", "left_semi").select("edge_id", "kind", "source", "target")


@q("relation_edges", f"WITH {S.E} SELECT edge_id, source, target FROM e WHERE kind = 'relates_to' AND (provenance IS NULL OR NOT starts_with(provenance, 'synthesis:reverse'))")
def relation_edges(s: SparkSession, d: str) -> DataFrame:
    return R.relation_edges(G.edges(s, d, "source", "target", "provenance")).select("edge_id", "source", "target")


@q(
    "class_methods",
    f"""WITH {S.N}, {S.E} SELECT DISTINCT e.source AS owner, e.target AS member, m.name FROM e JOIN n o ON o.id = e.source AND o.kind IN ('class', 'model')
JOIN n m ON m.id = e.target AND m.kind = 'method' WHERE e.kind = 'contains'""",
)
def class_methods(s: SparkSession, d: str) -> DataFrame:
    return R.members(G.edges(s, d, "source", "target"), G.nodes(s, d, "name", "signature"), ("class", "model"), ("method",)).select("owner", "member", "name")


_FIRST = r"trim(regexp_replace(split_part(regexp_extract(m.signature, '(?s)^[^(]*\((.*)$', 1), ',', 1), '\)+$', ''))"


@q(
    "field_relations",
    f"""WITH {S.N}, {S.E} SELECT DISTINCT e.source AS owner, e.target AS member, {_FIRST} AS related FROM e JOIN n o ON o.id = e.source AND o.kind IN ('class', 'model')
JOIN n m ON m.id = e.target AND m.kind = 'field' WHERE e.kind = 'contains' AND contains(m.signature, '(') AND split_part(m.signature, '(', 1) IN ({S.quoted(D.RELATION_FIELDS)})
AND {_FIRST} <> '' AND NOT contains({_FIRST}, '=')""",
)
def field_relations(s: SparkSession, d: str) -> DataFrame:
    return R.field_relations(G.edges(s, d, "source", "target"), G.nodes(s, d, "name", "signature"))


@q(
    "reverse_relations",
    f"""WITH {S.E}, fwd AS (SELECT DISTINCT source, target FROM e WHERE kind = 'relates_to' AND (provenance IS NULL OR NOT starts_with(provenance, 'synthesis:reverse'))
  AND source <> target AND {S.project('source')} = {S.project('target')})
SELECT target AS source, source AS target FROM fwd a WHERE NOT EXISTS (SELECT 1 FROM fwd b WHERE b.source = a.target AND b.target = a.source)""",
)
def reverse_relations(s: SparkSession, d: str) -> DataFrame:
    return R.reverse_relations(G.edges(s, d, "source", "target", "provenance"))


@q(
    "dark_callers",
    f"WITH {S.R} SELECT project_id, reference_name, count(*) AS pending FROM r WHERE reference_kind NOT IN ({S.quoted(D.PIPELINE_KINDS)}) GROUP BY ALL",
)
def dark_callers(s: SparkSession, d: str) -> DataFrame:
    return G.refs(s, d).where(~F.col("reference_kind").isin(*D.PIPELINE_KINDS)).groupBy("project_id", "reference_name").agg(F.count(F.lit(1)).alias("pending"))


@q(
    "unresolved_callees",
    f"""WITH {S.N}, {S.R} SELECT ref_id, from_node_id, reference_name FROM r JOIN n ON n.id = from_node_id
WHERE reference_kind = 'calls' AND reference_name NOT IN ({S.quoted(D.QUERYSET_BUILTINS)})""",
)
def unresolved_callees(s: SparkSession, d: str) -> DataFrame:
    r = G.refs(s, d).where((F.col("reference_kind") == "calls") & ~F.col("reference_name").isin(*D.QUERYSET_BUILTINS))
    n = G.nodes(s, d, "name").select(F.col("id").alias("from_node_id"))
    return r.join(n, "from_node_id", "left_semi").select("ref_id", "from_node_id", "reference_name")


@q("unresolved_by_source", f"WITH {S.R} SELECT from_node_id, count(*) AS pending FROM r GROUP BY ALL")
def unresolved_by_source(s: SparkSession, d: str) -> DataFrame:
    return G.refs(s, d).groupBy("from_node_id").agg(F.count(F.lit(1)).alias("pending"))


# --- links, orphans, lookups (C4, C5, C13, C14, C19, C21, C22, D4, L7, L10) ---------------------------


@q("link_pairs", f"WITH {S.E} SELECT {S.project('source')} AS from_project, {S.project('target')} AS to_project, count(*) AS links FROM e WHERE {S.project('source')} <> {S.project('target')} GROUP BY ALL")
def link_pairs(s: SparkSession, d: str) -> DataFrame:
    return R.link_pairs(G.edges(s, d, "source", "target"))


@q(
    "link_page",
    f"""WITH {S.N}, {S.E} SELECT edge_id, e.kind, a.name AS source_name, b.name AS target_name, provenance FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target
WHERE starts_with(provenance, 'link:') ORDER BY edge_id DESC LIMIT 200""",
)
def link_page(s: SparkSession, d: str) -> DataFrame:
    x = R.link_page(G.edges(s, d, "source", "target", "provenance"), G.nodes(s, d, "name"), 200)
    return x.select("edge_id", "kind", "source_name", "target_name", "provenance")


@q(
    "orphans",
    f"""WITH {S.N}, {S.E}, {S.R} SELECT id FROM n WHERE kind IN ({S.quoted(D.DEFINITION_KINDS)}) AND NOT {S.framework_reached('name', 'file_path')}
AND id NOT IN (SELECT target FROM e WHERE kind <> 'contains' AND target IS NOT NULL)
AND NOT EXISTS (SELECT 1 FROM r WHERE r.project_id = n.project_id AND r.reference_name = n.name AND reference_kind NOT IN ({S.quoted(D.PIPELINE_KINDS)}))""",
)
def orphans(s: SparkSession, d: str) -> DataFrame:
    return R.orphans(G.nodes(s, d, "project_id", "name", "file_path"), G.edges(s, d, "source", "target"), G.refs(s, d)).select("id")


@q(
    "innermost_symbol",
    f"""WITH {S.N}, {S.R} SELECT ref_id, id AS node_id, end_line - start_line AS size FROM r JOIN n ON n.project_id = r.project_id AND n.file_path = r.file_path
WHERE r.line BETWEEN start_line AND end_line AND n.kind NOT IN ('file', 'module', 'import') QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY size, id) = 1""",
)
def innermost_symbol(s: SparkSession, d: str) -> DataFrame:
    points = G.refs(s, d).where(F.col("line").isNotNull()).select(F.col("ref_id").alias("point_id"), "project_id", "file_path", F.col("line").alias("at"))
    n = G.nodes(s, d, "project_id", "file_path", "start_line", "end_line")
    return R.innermost(points, n).withColumnRenamed("point_id", "ref_id")


_HUNKS = """h AS (SELECT project_id, file_path, CAST(h_start AS INTEGER) AS h_start, CAST(h_start + 4 AS INTEGER) AS h_end FROM (
  SELECT DISTINCT project_id, file_path, (line // 40) * 40 + 1 AS h_start FROM unresolved_refs WHERE line IS NOT NULL))"""


def hunks(s: SparkSession, d: str) -> DataFrame:
    """Stand-in for a diff: five lines at the start of each forty that have a pending reference."""
    r = read(s, d, "unresolved_refs").where(F.col("line").isNotNull())
    start = (F.floor(F.col("line") / 40) * 40 + 1).cast("int")
    return r.select("project_id", "file_path", start.alias("h_start")).distinct().withColumn("h_end", F.col("h_start") + 4)


@q(
    "touched_symbols",
    f"""WITH {S.N}, {_HUNKS} SELECT id AS node_id, CAST(least(sum(least(end_line, h_end) - greatest(start_line, h_start) + 1), end_line - start_line + 1) AS BIGINT) AS lines
FROM h JOIN n ON n.project_id = h.project_id AND n.file_path = h.file_path AND start_line <= h_end AND end_line >= h_start
WHERE kind IN ('class', 'function', 'method', 'model', 'view') GROUP BY id, start_line, end_line""",
)
def touched_symbols(s: SparkSession, d: str) -> DataFrame:
    return R.touched(hunks(s, d), G.nodes(s, d, "project_id", "file_path", "start_line", "end_line"))


@q(
    "seed_cascade",
    f"""WITH {S.N}, s AS (SELECT DISTINCT reference_name AS symbol FROM unresolved_refs WHERE reference_name IS NOT NULL UNION SELECT DISTINCT regexp_extract(qualified_name, '([^.:]+\\.[^.:]+)$', 1) FROM nodes),
w AS (SELECT symbol, id, 1 AS way FROM s JOIN n ON symbol = qualified_name WHERE contains(symbol, '::')
UNION SELECT symbol, id, 2 FROM s JOIN n ON name = regexp_extract(symbol, '([^.]*)$', 1) WHERE contains(symbol, '.') AND NOT contains(symbol, '::')
  AND (qualified_name = symbol OR suffix(qualified_name, '.' || symbol) OR suffix(qualified_name, '::' || symbol))
UNION SELECT symbol, id, 3 FROM s JOIN n ON symbol = name
UNION SELECT symbol, id, 4 FROM s JOIN n ON contains(name, '/') AND symbol = regexp_extract(name, '([^/]*)$', 1))
SELECT symbol, way, count(*) AS meanings FROM (SELECT * FROM w QUALIFY way = min(way) OVER (PARTITION BY symbol)) GROUP BY ALL""",
)
def seed_cascade(s: SparkSession, d: str) -> DataFrame:
    """Name resolution for all pending names and all ``Owner.member`` tails."""
    n = read(s, d, "nodes")
    names = read(s, d, "unresolved_refs").select(F.col("reference_name").alias("symbol"))
    names = names.union(n.select(F.regexp_extract("qualified_name", r"([^.:]+\.[^.:]+)$", 1)))
    return R.seeds(names, G.nodes(s, d, "name", "qualified_name")).groupBy("symbol", "way").agg(F.count(F.lit(1)).alias("meanings"))


_TEMPLATE = r"regexp_replace(replace(file_path, '\', '/'), '^.*templates/', '')"


@q(
    "template_overrides",
    f"""WITH {S.N}, t AS (SELECT id, project_id, {_TEMPLATE} AS template FROM n WHERE kind = 'template'),
o AS (SELECT template, id AS target, project_id AS owner FROM t WHERE template IN (SELECT template FROM t GROUP BY template HAVING count(DISTINCT project_id) > 1)
  QUALIFY row_number() OVER (PARTITION BY template ORDER BY CASE WHEN split_part(template, '/', 1) = project_id THEN 0 ELSE 1 END, project_id, id) = 1)
SELECT id AS source, target FROM t JOIN o USING (template) WHERE project_id <> owner""",
)
def template_overrides(s: SparkSession, d: str) -> DataFrame:
    return R.template_overrides(G.nodes(s, d, "project_id", "file_path"))


@q(
    "event_links",
    f"""WITH {S.N}, di AS (SELECT DISTINCT id, regexp_replace(name, '^_?([a-z]+)_([a-z]+)$', '\\2_\\1') AS event FROM n WHERE kind IN ('function', 'method') AND regexp_matches(name, '^_?[a-z]+_[a-z]+$')),
li AS (SELECT DISTINCT id, regexp_extract(x, '(on_\\w+)$', 1)[4:] AS event FROM (SELECT id, unnest(regexp_extract_all(decorators, '(?:^|[^\\w.])on_\\w+')) AS x FROM n)),
k AS (SELECT event FROM (SELECT event, count(*) AS a FROM di GROUP BY event) JOIN (SELECT event, count(*) AS b FROM li GROUP BY event) USING (event) WHERE a * b <= 64)
SELECT DISTINCT di.id AS source, li.id AS target FROM k JOIN di USING (event) JOIN li USING (event) WHERE di.id <> li.id""",
)
def event_links(s: SparkSession, d: str) -> DataFrame:
    """Listeners carry ``@on_<noun>_<verb>``, dispatchers are named ``<verb>_<noun>``."""
    n = G.nodes(s, d, "name", "decorators")
    named = n.where(F.col("kind").isin("function", "method") & F.col("name").rlike("^_?[a-z]+_[a-z]+$"))
    dispatch = named.select("id", F.regexp_replace("name", "^_?([a-z]+)_([a-z]+)$", "$2_$1").alias("event"))
    on = F.explode(F.regexp_extract_all("decorators", F.lit(r"(?:^|[^\w.])(on_\w+)"), F.lit(1)))
    listen = n.select("id", on.alias("x")).select("id", F.substring("x", 4, 1000).alias("event"))
    return R.event_links(dispatch, listen)


# --- scalar functions over whole tables (1.5, H) --------------------------------------------------------


@q(
    "path_facts",
    rf"""SELECT DISTINCT project_id, path, {S.test_path('path')} AS is_test, {S.generated_path('path')} AS is_generated, {S.migration_path('path')} AS is_migration,
  {S.penalty('path')} AS penalty, {S.app('path')} AS app, regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '^(.*)\.[^.]*$', '\1') AS stem,
  replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '\.[^./]*$', ''), '/__init__$', ''), '/', '.') AS module FROM files""",
)
def path_facts(s: SparkSession, d: str) -> DataFrame:
    f = read(s, d, "files").select("project_id", "path").distinct()
    return f.select(
        "project_id",
        "path",
        P.is_test_path("path").alias("is_test"),
        P.is_generated_path("path").alias("is_generated"),
        P.is_migration_path("path").alias("is_migration"),
        P.path_penalty("path").alias("penalty"),
        P.app_segment("path").alias("app"),
        P.file_stem("path").alias("stem"),
        P.dotted_module("path").alias("module"),
    )


@q(
    "symbol_roles",
    rf"""WITH {S.N}, x AS (SELECT CASE WHEN kind IN ('route', 'template', 'model') THEN kind WHEN kind = 'selector' THEN 'css-selector' WHEN {S.test_path('file_path')} THEN 'test'
  WHEN regexp_matches(name, '(QuerySet|Manager)$') THEN 'queryset' WHEN regexp_matches(name, '(Service|Form|Serializer|Admin|Choices)$') THEN lower(regexp_extract(name, '(Service|Form|Serializer|Admin|Choices)$', 1))
  WHEN regexp_matches(file_path, '(json|form|page|template)_views') THEN regexp_extract(file_path, '(json|form|page|template)_views', 1) || '-view'
  WHEN suffix(file_path, '/views.py') OR contains(file_path, '/views/') THEN 'view' WHEN contains(file_path, 'queryset') THEN 'queryset' WHEN contains(file_path, 'factories') OR contains(file_path, 'factory') THEN 'factory'
  WHEN suffix(file_path, '/services.py') OR contains(file_path, '/services/') THEN 'service' WHEN suffix(file_path, '/forms.py') THEN 'form' WHEN suffix(file_path, '/admin.py') THEN 'admin'
  WHEN suffix(file_path, '/serializers.py') THEN 'serializer' END AS role FROM n) SELECT role, count(*) AS symbols FROM x GROUP BY role""",
)
def symbol_roles(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "name", "file_path")
    return n.groupBy(P.symbol_role("kind", "name", "file_path").alias("role")).agg(F.count(F.lit(1)).alias("symbols"))


_WORD = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(name), '{w}') OR contains(lower(qualified_name), '{w}') THEN '{w}' END" for w in D.SECURITY_WORDS) + ")"


@q("security_keywords", f"WITH {S.N} SELECT {_WORD} AS keyword, count(*) AS symbols FROM n GROUP BY ALL")
def security_keywords(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "name", "qualified_name")
    return n.groupBy(P.security_keyword("name", "qualified_name").alias("keyword")).agg(F.count(F.lit(1)).alias("symbols"))


@q(
    "import_lines",
    rf"""WITH {S.N}, x AS (SELECT id, kind, language, regexp_replace(regexp_replace(replace(file_path, '\', '/'), '\.py$', ''), '/__init__$', '') AS m, replace(file_path, '\', '/') AS p,
  split_part(string_split(qualified_name, '::')[-1], '.', 1) AS o FROM n)
SELECT id, CASE WHEN language = 'python' AND kind NOT IN ('file', 'import', 'module', 'route', 'template', 'selector', 'parameter', 'external') AND suffix(p, '.py') AND m <> '' AND o <> ''
  THEN 'from ' || replace(m, '/', '.') || ' import ' || o END AS line FROM x""",
)
def import_lines(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "language", "file_path", "qualified_name")
    return n.select("id", P.python_import_line("language", "kind", "file_path", "qualified_name").alias("line"))


@q(
    "listing_page",
    f"WITH {S.N} SELECT id, kind, file_path, start_line FROM n ORDER BY {S.kind_rank('kind')}, {S.penalty('file_path')}, file_path NULLS FIRST, start_line NULLS FIRST, id LIMIT 50 OFFSET 100",
)
def listing_page(s: SparkSession, d: str) -> DataFrame:
    n = G.nodes(s, d, "file_path", "start_line")
    return R.page(n, P.listing_order(), 100, 50).select("id", "kind", "file_path", "start_line")


# --- history (D6-D9, E1-E3, L11) ------------------------------------------------------------------------


@q(
    "history_by_commit",
    f"""WITH {S.COMMITS} SELECT commit_hash, author, committed_at, count(*) AS files, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions
FROM commits JOIN commit_files USING (project_id, commit_hash) WHERE file_path ILIKE '%brand_1%' GROUP BY ALL""".replace("brand_1", "1/"),
)
def history_by_commit(s: SparkSession, d: str) -> DataFrame:
    x = T.by_commit(G.commits(s, d), G.commit_files(s, d), "%1/%")
    return x.select("commit_hash", "author", "committed_at", "files", "insertions", "deletions")


@q(
    "churn",
    f"WITH {S.COMMITS} SELECT file_path, count(DISTINCT commit_hash) AS commits, max(committed_at) AS latest FROM commits JOIN commit_files USING (project_id, commit_hash) WHERE committed_at >= {SINCE} GROUP BY ALL",
)
def churn(s: SparkSession, d: str) -> DataFrame:
    return T.churn(G.commits(s, d), G.commit_files(s, d), SINCE).select("file_path", "commits", "latest")


@q(
    "file_touches",
    f"""WITH {S.COMMITS} SELECT file_path, commit_hash, committed_at, CAST(row_number() OVER (PARTITION BY file_path ORDER BY committed_at, commit_hash) AS INTEGER) AS revision
FROM (SELECT DISTINCT project_id, commit_hash, file_path FROM commit_files) JOIN commits USING (project_id, commit_hash)""",
)
def file_touches(s: SparkSession, d: str) -> DataFrame:
    return T.file_touches(G.commits(s, d), G.commit_files(s, d)).select("file_path", "commit_hash", "committed_at", "revision")


@q("symbol_changes", f"WITH {S.CHANGES} SELECT qualified_name, commit_hash, change_kind, signature FROM changes WHERE change_kind IS NOT NULL")
def symbol_changes(s: SparkSession, d: str) -> DataFrame:
    return T.symbol_changes(G.revisions(s, d)).select("qualified_name", "commit_hash", "change_kind", "signature")


@q(
    "as_of",
    f"""WITH {S.CHANGES} SELECT qualified_name, commit_hash, signature FROM changes WHERE change_kind IS NOT NULL AND committed_at <= {AT}
QUALIFY row_number() OVER (PARTITION BY project_id, file_path, qualified_name ORDER BY committed_at DESC, commit_hash DESC) = 1""",
)
def as_of(s: SparkSession, d: str) -> DataFrame:
    return T.as_of(T.symbol_changes(G.revisions(s, d)), AT).select("qualified_name", "commit_hash", "signature")


@q("changed_since", f"WITH {S.CHANGES} SELECT DISTINCT qualified_name FROM changes WHERE change_kind IS NOT NULL AND committed_at >= {AT}")
def changed_since(s: SparkSession, d: str) -> DataFrame:
    return T.changed_since(T.symbol_changes(G.revisions(s, d)), AT)


_TRIO = "SELECT DISTINCT project_id, file_path, commit_hash, committed_at FROM revisions"


@q(
    "revision_diff",
    f"""WITH {S.REVISIONS}, t AS (SELECT *, lead(commit_hash) OVER (PARTITION BY project_id, file_path ORDER BY committed_at, commit_hash) AS following FROM ({_TRIO})),
a AS (SELECT file_path, commit_hash, qualified_name, signature FROM revisions),
b AS (SELECT t.file_path, t.following AS commit_hash, r.qualified_name, r.signature FROM t JOIN revisions r ON r.file_path = t.file_path AND r.commit_hash = t.commit_hash WHERE t.following IS NOT NULL)
SELECT file_path, commit_hash, qualified_name, CASE WHEN hb IS NULL THEN 'added' WHEN ha IS NULL THEN 'removed' ELSE 'modified' END AS change_kind, coalesce(sa, sb) AS signature
FROM (SELECT file_path, commit_hash, qualified_name, signature AS sa, 1 AS ha FROM a) FULL JOIN (SELECT file_path, commit_hash, qualified_name, signature AS sb, 1 AS hb FROM b) USING (file_path, commit_hash, qualified_name)
WHERE ha IS NULL OR hb IS NULL OR sa IS DISTINCT FROM sb""",
)
def revision_diff(s: SparkSession, d: str) -> DataFrame:
    r = G.revisions(s, d)
    t = r.select("project_id", "file_path", "commit_hash", "committed_at")
    return T.diff_revisions(t, r.select("project_id", "file_path", "commit_hash", "qualified_name", "signature")).drop("project_id")
