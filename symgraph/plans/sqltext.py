"""Pieces of SQL that the checking queries share (DuckDB)."""

from __future__ import annotations

from ..functions import domain as D


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


#: The valid nodes and edges as CTEs ``n`` and ``e``.
N = f"""n AS (
  SELECT * EXCLUDE (kind, rn), lower(trim(kind)) AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM nodes WHERE id IS NOT NULL)
  WHERE rn = 1 AND lower(trim(kind)) IN ({quoted(D.NODE_KINDS)}))"""
E = f"""e AS (
  SELECT DISTINCT edge_id, source, target, lower(trim(kind)) AS kind, line, col, provenance FROM edges
  WHERE lower(trim(kind)) IN ({quoted(D.EDGE_KINDS)}))"""
R = "r AS (SELECT DISTINCT * EXCLUDE (reference_kind), lower(trim(reference_kind)) AS reference_kind FROM unresolved_refs)"
FILES = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY project_id, path ORDER BY indexed_at DESC) = 1)"
COMMITS = """commits AS (SELECT 'shop' AS project_id, CAST(o_orderkey AS VARCHAR) AS commit_hash, CAST(o_custkey AS VARCHAR) AS author,
  CAST(epoch(o_orderdate) AS BIGINT) AS committed_at, o_orderpriority AS summary FROM orders),
commit_files AS (SELECT 'shop' AS project_id, CAST(l_orderkey AS VARCHAR) AS commit_hash, p_brand || '/' || replace(p_type, ' ', '_') AS file_path,
  CAST(l_quantity AS BIGINT) AS insertions, CAST(l_linenumber AS BIGINT) AS deletions FROM lineitem JOIN part ON p_partkey = l_partkey)"""
REVISIONS = """revisions AS (SELECT 'shop' AS project_id, 'users/' || user_id AS file_path, user_id || '::' || event_type AS qualified_name,
  CAST(event_id AS VARCHAR) AS commit_hash, CAST(floor(epoch(ts)) AS BIGINT) AS committed_at, json_extract_string(props, '$.k') AS signature FROM events)"""
CHANGES = (
    REVISIONS
    + """,
changes AS (SELECT *, CASE WHEN nr = 1 THEN 'added' WHEN before IS DISTINCT FROM signature THEN 'modified' END AS change_kind FROM (
  SELECT *, lag(signature) OVER w AS before, row_number() OVER w AS nr FROM revisions
  WINDOW w AS (PARTITION BY project_id, file_path, qualified_name ORDER BY committed_at, CAST(commit_hash AS BIGINT), commit_hash)))"""
)


def test_path(c: str) -> str:
    return rf"regexp_matches({c}, '(^|[/\\])tests?[/\\]|(^|[/\\])(test_|conftest)[^/\\]*$|(_test\.py|\.test\.js|\.spec\.js)$', 'i')"


def generated_path(c: str) -> str:
    return rf"regexp_matches({c}, '\.(bundle\.js|min\.css|min\.js)$|_pb2\.py$|(^|[/\\])(migrations|node_modules|static_files|staticfiles|vendor)[/\\]', 'i')"


def migration_path(c: str) -> str:
    return rf"regexp_matches({c}, '(^|[/\\])migrations[/\\]', 'i')"


def command_path(c: str) -> str:
    return rf"regexp_matches({c}, '(^|[/\\])management[/\\]+commands[/\\]', 'i')"


def penalty(c: str) -> str:
    return f"CASE WHEN {generated_path(c)} THEN 2 WHEN {test_path(c)} THEN 1 ELSE 0 END"


def kind_rank(c: str) -> str:
    return f"""CASE WHEN {c} IN ('model','class','function','method','view','route','template','selector') THEN 0 WHEN {c} IN ('field','property') THEN 1
  WHEN {c} IN ('module','file','external') THEN 2 WHEN {c} IN ('constant','variable','parameter') THEN 3 ELSE 4 END"""


def edge_rank(c: str) -> str:
    return f"CASE WHEN {c} = 'contains' THEN 3 WHEN {c} IN ('imports','references') THEN 2 WHEN {c} IN ('returns','type_of') THEN 1 ELSE 0 END"


def app(c: str) -> str:
    return rf"regexp_extract({c}, '^([^/\\]*)', 1)"


def project(c: str) -> str:
    return f"split_part({c}, '::', 1)"


def covering(kind: str, path: str) -> str:
    return f"({kind} = 'tests' OR ({kind} <> 'contains' AND {test_path(path)}))"


def sensitive(name: str, qualified: str) -> str:
    return f"regexp_matches(lower({name}) || ' ' || lower({qualified}), '{'|'.join(D.SECURITY_WORDS)}')"


def framework_reached(name: str, path: str) -> str:
    p = rf"replace({path}, '\', '/')"
    return f"""({test_path(p)} OR {migration_path(p)} OR {command_path(p)} OR suffix({p}, '__init__.py') OR suffix({p}, 'admin.py')
  OR (length({name}) > 4 AND starts_with({name}, '__') AND suffix({name}, '__')) OR {name} IN ({quoted(D.HOOK_NAMES)}) OR regexp_matches({name}, '(Admin|Config|Migration)$'))"""
