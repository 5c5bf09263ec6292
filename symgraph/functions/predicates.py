"""Scalar semantics that all operators share, as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domain as D

_SEP = r"[/\\]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: str | Column) -> Column:
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def forward(path: str | Column) -> Column:
    """The path with forward slashes only."""
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def base_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def app_segment(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"^([^/\\]*)", 1)


def file_stem(path: str | Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(base_name(path), r"^(.*)\.[^.]*$", "$1")


def directory(path: str | Column) -> Column:
    """Everything before the last separator, or an empty text."""
    return F.regexp_extract(col(path), r"^(.*)[/\\][^/\\]*$", 1)


TEST_PATH = rf"(?i)(^|{_SEP})tests?{_SEP}|(^|{_SEP})(test_|conftest)[^/\\]*$|(_test\.py|\.test\.js|\.spec\.js)$"
MINIFIED_PATH = r"(?i)\.(bundle\.js|min\.css|min\.js)$"
GENERATED_PATH = rf"(?i)\.(bundle\.js|min\.css|min\.js)$|_pb2\.py$|(^|{_SEP})(migrations|node_modules|static_files|staticfiles|vendor){_SEP}"
MIGRATION_PATH = rf"(?i)(^|{_SEP})migrations{_SEP}"
COMMAND_PATH = rf"(?i)(^|{_SEP})management{_SEP}+commands{_SEP}"


def is_test_path(path: str | Column) -> Column:
    return col(path).rlike(TEST_PATH)


def is_minified_path(path: str | Column) -> Column:
    return col(path).rlike(MINIFIED_PATH)


def is_minified_source(text: str | Column) -> Column:
    """A line of more than 2,000 bytes."""
    return F.exists(F.split(col(text), "\r\n|\n|\r"), lambda x: F.octet_length(x) > 2000)


def is_generated_path(path: str | Column) -> Column:
    return col(path).rlike(GENERATED_PATH)


def is_migration_path(path: str | Column) -> Column:
    return col(path).rlike(MIGRATION_PATH)


def is_command_path(path: str | Column) -> Column:
    return col(path).rlike(COMMAND_PATH)


def path_penalty(path: str | Column) -> Column:
    return F.when(is_generated_path(path), 2).when(is_test_path(path), 1).otherwise(0)


def is_covering(kind: str | Column, path: str | Column) -> Column:
    return (col(kind) == "tests") | ((col(kind) != "contains") & is_test_path(path))


def security_keyword(name: str | Column, qualified: str | Column) -> Column:
    """The first keyword (in the list's order) that either name contains, or null."""
    n, q = ascii_lower(name), ascii_lower(qualified)
    return F.coalesce(*[F.when(n.contains(w) | q.contains(w), F.lit(w)) for w in D.SECURITY_WORDS])


def is_sensitive(name: str | Column, qualified: str | Column) -> Column:
    words = "|".join(D.SECURITY_WORDS)
    return F.concat_ws(" ", ascii_lower(name), ascii_lower(qualified)).rlike(words)


def is_dunder(name: str | Column) -> Column:
    return (F.length(col(name)) > 4) & col(name).startswith("__") & col(name).endswith("__")


def is_framework_reached(name: str | Column, path: str | Column, hooks: tuple[str, ...] = D.HOOK_NAMES) -> Column:
    p, n = forward(path), col(name)
    suffix = n.rlike("(" + "|".join(D.FRAMEWORK_SUFFIXES) + ")$")
    return is_test_path(p) | is_migration_path(p) | is_command_path(p) | p.endswith("__init__.py") | p.endswith("admin.py") | is_dunder(n) | n.isin(*hooks) | suffix


def relation_target(signature: str | Column) -> Column:
    """The model that a relation field's declaration names first, or null."""
    s = col(signature)
    first = F.trim(F.regexp_replace(F.split(F.regexp_extract(s, r"(?s)^[^(]*\((.*)$", 1), ",")[0], r"\)+$", ""))
    ok = F.split(s, r"\(")[0].isin(*D.RELATION_FIELDS) & s.contains("(") & (first != "") & ~first.contains("=")
    return F.when(ok, first)


def qualified_ends_with(qualified: str | Column, suffix: str) -> Column:
    """Equal, or ending in the suffix behind ``.`` or ``::``."""
    q = col(qualified)
    return (q == suffix) | q.endswith("." + suffix) | q.endswith("::" + suffix)


def is_definition(kind: str | Column) -> Column:
    return col(kind).isin(*D.DEFINITION_KINDS)


def kind_rank(kind: str | Column) -> Column:
    k = col(kind)
    return (
        F.when(k.isin("model", "class", "function", "method", "view", "route", "template", "selector"), 0)
        .when(k.isin("field", "property"), 1)
        .when(k.isin("module", "file", "external"), 2)
        .when(k.isin("constant", "variable", "parameter"), 3)
        .otherwise(4)
    )


def edge_rank(kind: str | Column) -> Column:
    k = col(kind)
    return F.when(k == "contains", 3).when(k.isin("imports", "references"), 2).when(k.isin("returns", "type_of"), 1).otherwise(0)


def listing_order(prefix: str = "") -> list[Column]:
    """Kind rank, path penalty, file, line, id: a total order."""
    c = lambda x: F.col(f"{prefix}{x}")
    return [kind_rank(c("kind")), path_penalty(c("file_path")), c("file_path"), c("start_line"), c("id")]


def symbol_role(kind: str | Column, name: str | Column, path: str | Column) -> Column:
    """The architectural layer by kind, class suffix and path; null for ordinary code."""
    k, n, p = col(kind), col(name), col(path)
    return (
        F.when(k.isin("route", "template", "model"), k)
        .when(k == "selector", "css-selector")
        .when(is_test_path(p), "test")
        .when(n.rlike("(QuerySet|Manager)$"), "queryset")
        .when(n.rlike("(Service|Form|Serializer|Admin|Choices)$"), F.lower(F.regexp_extract(n, "(Service|Form|Serializer|Admin|Choices)$", 1)))
        .when(p.rlike("(json|form|page|template)_views"), F.concat(F.regexp_extract(p, "(?:.*?)(json|form|page|template)_views", 1), F.lit("-view")))
        .when(p.endswith("/views.py") | p.contains("/views/"), "view")
        .when(p.contains("queryset"), "queryset")
        .when(p.contains("factories") | p.contains("factory"), "factory")
        .when(p.endswith("/services.py") | p.contains("/services/"), "service")
        .when(p.endswith("/forms.py"), "form")
        .when(p.endswith("/admin.py"), "admin")
        .when(p.endswith("/serializers.py"), "serializer")
    )


def dotted_module(path: str | Column) -> Column:
    """``a/b/c.py`` as ``a.b.c``; a package's ``__init__`` as the package."""
    p = F.regexp_replace(forward(path), r"\.[^./]*$", "")
    return F.replace(F.regexp_replace(p, r"/__init__$", ""), F.lit("/"), F.lit("."))


def module_matches(path: str | Column, module: str | Column) -> Column:
    """Either dotted name ends with the other (a plain suffix, no dot boundary)."""
    d, m = dotted_module(path), col(module)
    return F.endswith(d, m) | F.endswith(m, d)


def python_import_line(language: str | Column, kind: str | Column, path: str | Column, qualified: str | Column) -> Column:
    p, q = forward(path), col(qualified)
    module = F.regexp_replace(F.regexp_replace(p, r"\.py$", ""), r"/__init__$", "")
    owner = F.substring_index(F.substring_index(q, "::", -1), ".", 1)
    barred = col(kind).isin("file", "import", "module", "route", "template", "selector", "parameter", "external")
    ok = (col(language) == "python") & ~barred & p.endswith(".py") & (module != "") & (owner != "")
    return F.when(ok, F.concat(F.lit("from "), F.replace(module, F.lit("/"), F.lit(".")), F.lit(" import "), owner))


def shared_depth(a: str | Column, b: str | Column) -> Column:
    """How many leading directory segments two paths share."""
    x, y = F.split(directory(a), _SEP), F.split(directory(b), _SEP)
    same = F.zip_with(x, y, lambda s, t: F.when((s == t) & (s != ""), 1).otherwise(0))
    return F.aggregate(
        same,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, v: F.struct((acc["n"] + F.when(acc["on"], F.coalesce(v, F.lit(0))).otherwise(0)).alias("n"), (acc["on"] & (F.coalesce(v, F.lit(0)) == 1)).alias("on")),
        lambda acc: acc["n"],
    )


def top_owner(qualified: str | Column) -> Column:
    """The outermost name behind the last ``::``."""
    return F.substring_index(F.substring_index(col(qualified), "::", -1), ".", 1)


def owner_name(qualified: str | Column) -> Column:
    """The qualified name without its last ``.member``, or null for a name without an owner."""
    q = col(qualified)
    return F.when(F.substring_index(q, "::", -1).contains("."), F.regexp_replace(q, r"\.[^.]*$", ""))


def project_of(node_id: str | Column) -> Column:
    return F.substring_index(col(node_id), "::", 1)


def url_scope(path: str | Column) -> Column:
    """The app path of an URL module: without the file, a ``urls`` package and a leading app folder."""
    d = F.regexp_extract(forward(path), r"^(.*)/[^/]*$", 1)
    d = F.regexp_replace(d, r"(^|/)urls$", "")
    return F.nullif(F.regexp_replace(d, r"^(apps?)(/|$)", ""), F.lit(""))


def flow_name(kind: str | Column, name: str | Column, qualified: str | Column, path: str | Column) -> Column:
    q = col(qualified)
    pattern = F.when(q.contains("route::"), F.split(q, "route::")[1]).otherwise(col(name))
    tail = F.substring_index(q, "::", -1)
    routed = F.when(pattern != "", F.concat_ws(" ", url_scope(path), pattern))
    return F.coalesce(F.when(col(kind) == "route", routed), F.nullif(tail, F.lit("")), col(name))


def language_of(path: str | Column) -> Column:
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("py", "pyi"), "python").when(ext.isin("htm", "html"), "htmldjango").when(ext.isin("js", "mjs"), "javascript").when(ext == "css", "css")


def directory_at(path: str | Column, depth: int) -> Column:
    """The first ``depth`` directory segments, ``(root)`` for a file without one."""
    segments = F.split(forward(path), "/")
    n = F.least(F.size(segments) - 1, F.lit(depth))
    return F.when(n <= 0, "(root)").otherwise(F.array_join(F.slice(segments, F.lit(1), F.greatest(n, F.lit(1))), "/"))


def saturating(value: str | Column, bound: float) -> Column:
    return F.least(col(value).cast("double"), F.lit(float(bound))) / F.lit(float(bound))


def commit_recency(age_days: str | Column) -> Column:
    """Exponential decay over a week; 0 for the future and beyond."""
    a = col(age_days)
    return F.when((a < 0) | (a > D.RECENCY_DAYS), 0.0).otherwise(F.exp(-D.RECENCY_DECAY * a))


def epoch_of_day(text: str | Column) -> Column:
    """``YYYY-MM-DD`` as seconds at midnight UTC; a day beyond its month rolls over, else null."""
    rx = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$"
    year, month, day = (F.regexp_extract(col(text), rx, i).try_cast("int") for i in (1, 2, 3))
    first = F.make_date(year, month, F.lit(1))
    return F.when(month.between(1, 12) & day.between(1, 31), (F.unix_date(first).cast("long") + day - 1) * 86_400)


def day_of_epoch(seconds: str | Column) -> Column:
    return F.date_format(F.date_from_unix_date(F.floor(col(seconds) / 86_400).cast("int")), "yyyy-MM-dd")


def file_recency(dirty: str | Column, session: str | Column, commit: str | Column) -> Column:
    w = D.RECENCY_WEIGHTS
    total = col(dirty) * w["dirty"] + col(session) * w["session"] + col(commit) * w["commit"]
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def recency_bonus(median: str | Column, recency: str | Column) -> Column:
    return F.round(col(median) * D.RECENCY_BONUS * col(recency)).cast("long")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """How many lines two closed ranges share."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)


def glob(pattern: str, text: str | Column) -> Column:
    """An anchored glob of ``*`` and ``?`` on lower-cased text; too long a pattern or text never matches."""
    import re

    if len(pattern) > 256:
        return F.lit(False)
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return (F.length(col(text)) <= 4096) & ascii_lower(text).rlike(f"(?s)^{rx}$")


def qualify_handler(candidates: str | Column, name: str | Column) -> Column:
    """The first of a JSON array of candidates as the owner of ``name``."""
    first = F.get(F.from_json(col(candidates), "array<string>"), F.lit(0))
    return F.when(first.isNull(), col(name)).otherwise(F.concat(first, F.lit("."), col(name)))


def content_hash(text: str | Column) -> Column:
    return F.sha2(col(text), 256)


def node_line(prefix: str = "") -> Column:
    """``kind name (file:line)``."""
    c = lambda x: F.col(f"{prefix}{x}")
    return F.concat(c("kind"), F.lit(" "), c("name"), F.lit(" ("), c("file_path"), F.lit(":"), c("start_line").cast("string"), F.lit(")"))
