"""Binding references to definitions: bind if unique, else abstain.

Every strategy yields at most one target per reference, with a confidence. Uniqueness is decided
on aggregates per key (a count and the only id), so references never meet all candidates of a
popular name. Locality (the candidate that shares most leading folders) is decided the same way:
candidates are reduced to one id per folder prefix, a reference looks up its own prefixes, and
the longest one found wins. Ties end in the smallest id. Null names bind to nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import predicates as P
from ..session import Scratch

#: The mark before a candidate that steers dispatch instead of naming something.
MARK = "\x01"
# Suffixes of the classes that carry a model's queryset or service methods.
MANAGERS = ("Manager", "QuerySet", "QuerySetManager")
SERVICES = ("FactoryService", "IntelligenceService", "ProcessorService", "Service", "TransformationService")
SERVICE_BUILTINS = ("save_model_obj", "save_model_objs")

OUT = ("ref_id", "target", "confidence", "strategy")


def _out(df: DataFrame, confidence: float | Column, strategy: str) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select("ref_id", "target", c.cast("double").alias("confidence"), F.lit(strategy).alias("strategy"))


def _unique(nodes: DataFrame, *keys: Column | str) -> DataFrame:
    """Per key its only node: keys with several are left out."""
    return nodes.groupBy(*keys).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("target")).where(F.col("_n") == 1).drop("_n")


def steering(candidates: DataFrame) -> DataFrame:
    """``(ref_id, queryset, service, typed, super_, plain)``: what a reference's candidates say.

    ``plain``: the first candidate that is not a mark; one aggregate over the items.
    """
    item = F.col("item")
    has = lambda w: F.max(item == MARK + w)
    return candidates.groupBy("ref_id").agg(
        has("queryset-dispatch").alias("queryset"),
        has("service-dispatch").alias("service"),
        has("typed-receiver").alias("typed"),
        has("super-dispatch").alias("super_"),
        F.min(F.when(~item.startswith(MARK) & (item != ""), F.struct("pos", "item"))).alias("_p"),
        F.max(item.startswith(MARK)).alias("marked"),
    ).withColumn("plain", F.col("_p.item")).drop("_p")


def _preferred(kind: Column) -> Column:
    """The kinds that a reference kind prefers, as an array."""
    table = F.create_map(*[x for k, v in D.PREFERRED_KINDS.items() if k for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    return F.coalesce(table[kind], F.array(*[F.lit(i) for i in D.PREFERRED_KINDS[""]]))


def _prefixes(path: Column) -> Column:
    """The leading folders of a path as ``depth|prefix``, from none to all (at most 64)."""
    parts = F.split(P.directory(path), r"[/\\]")
    real = F.filter(parts, lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.least(F.size(real), F.lit(64))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(real, F.lit(1), i), "/").alias("prefix")))


def by_locality(refs: DataFrame, nodes: DataFrame, fold: bool = False, languages: bool = False) -> DataFrame:
    """Exact (or, with ``fold``, case-blind) names to preferred kinds by locality; or the sole
    other definition, where the kind of reference allows it.

    ``refs(ref_id, project_id, reference_name, reference_kind, file_path)``. Confidence 0.9 for
    the only preferred candidate, 0.6 among several (0.5 and 0.4 folded). ``languages``: within
    the language that the kind of reference leads to (``refs`` and ``nodes`` have ``language``);
    a name without a definition there may bind to another one, unless the kind is strict.
    """
    key = (lambda c: F.lower(c)) if fold else (lambda c: F.col(c))
    hi, lo = (0.5, 0.4) if fold else (0.9, 0.6)
    r = refs.where(F.col("reference_name").isNotNull() & F.col("reference_kind").isNotNull()).withColumn("_name", key("reference_name"))
    n = nodes.where(~F.col("kind").isin("import", "external")).withColumn("_name", key("name"))
    asked = r.select("project_id", "_name").distinct()
    n = n.join(asked, ["project_id", "_name"], "left_semi")
    # a node answers under its own language and under any
    spoken = F.array(F.lit("*"), F.coalesce("language", F.lit(""))) if languages else F.array(F.lit("*"))
    n = n.select("id", "project_id", "_name", "kind", "file_path", F.explode(spoken).alias("_lang"))
    if languages:
        there = n.select("project_id", "_name", "_lang").distinct().withColumn("_there", F.lit(True))
        r = r.withColumn("_lang", F.coalesce(_target_language(), F.lit("*"))).join(there, ["project_id", "_name", "_lang"], "left")
        r = r.where(F.col("_there") | ~F.col("reference_kind").isin(*STRICT_LANGUAGE)).withColumn("_lang", F.when(F.col("_there"), F.col("_lang")).otherwise("*"))
    else:
        r = r.withColumn("_lang", F.lit("*"))
    by = ["project_id", "_name", "_lang"]
    counts = n.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("c"))
    places = n.select("id", *by, "kind", F.explode(_prefixes(F.col("file_path"))).alias("p"))
    places = places.groupBy(*by, "kind", "p.prefix").agg(F.min("id").alias("target"))
    wanted = r.select("ref_id", *by, F.explode(_preferred(F.col("reference_kind"))).alias("kind"), "file_path")
    total = wanted.join(counts, [*by, "kind"]).groupBy("ref_id").agg(F.sum("c").alias("n"))
    at = wanted.select("ref_id", *by, "kind", F.explode(_prefixes(F.coalesce("file_path", F.lit("")))).alias("p")).select("*", "p.*")
    best = at.join(places, [*by, "kind", "prefix"]).groupBy("ref_id").agg(F.min(F.struct((-F.col("depth")).alias("d"), "target")).alias("b"))
    near = best.join(total, "ref_id").select("ref_id", F.col("b.target").alias("target"), F.when(F.col("n") == 1, hi).otherwise(lo).alias("c"))
    # nothing preferred: the only definition of the name, unless the reference is strict
    loose = n.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "kind")).alias("o")).where((F.col("m") == 1) & ~F.col("o.kind").isin(*D.LOOSE_BARRED))
    rest = r.where(~F.col("reference_kind").isin(*D.STRICT_KINDS)).join(near.select("ref_id"), "ref_id", "left_anti").join(loose, by)
    rest = rest.select("ref_id", F.col("o.id").alias("target"), F.lit(lo).alias("c"))
    return _out(near.unionByName(rest), F.col("c"), "fuzzy" if fold else "exact")


# The language that a kind of reference leads to, and kinds that lead to no other.
TARGET_LANGUAGE = {k: "python" for k in ("routes_to", "relates_to", "receives", "admin_of", "tests", "reads", "returns", "type_of", "uses_tag")} | {"handles": "javascript"}
STRICT_LANGUAGE = ("handles", "instantiates")


def _target_language() -> Column:
    own = F.when(F.lower("language").isin("py", "python"), "python").when(F.lower("language").isin("javascript", "htmldjango"), "javascript")
    table = F.create_map(*[F.lit(x) for kv in TARGET_LANGUAGE.items() for x in kv])
    return F.when(F.col("reference_kind") == "instantiates", own).otherwise(table[F.col("reference_kind")])


def _nearest(pairs: DataFrame, hi: float, lo: float, strategy: str) -> DataFrame:
    """Of scoped candidates ``(ref_id, reference_kind, r_path, id, kind, file_path)`` the
    preferred one in the nearest folder, or the sole loose one."""
    p = pairs.where(~F.col("kind").isin("import", "external")).distinct()
    p = p.withColumn("pref", F.array_contains(_preferred(F.col("reference_kind")), F.col("kind"))).withColumn("depth", P.shared_depth("r_path", "file_path"))
    best = F.min(F.when(F.col("pref"), F.struct((-F.col("depth")).alias("d"), "id"))).alias("b")
    g = p.groupBy("ref_id", "reference_kind").agg(F.count(F.when(F.col("pref"), 1)).alias("n"), F.count(F.lit(1)).alias("m"), best, F.min(F.struct("id", "kind")).alias("o"))
    near = g.where(F.col("n") > 0).select("ref_id", F.col("b.id").alias("target"), F.when(F.col("n") == 1, hi).otherwise(lo).alias("c"))
    loose = g.where((F.col("n") == 0) & (F.col("m") == 1) & ~F.col("reference_kind").isin(*D.STRICT_KINDS) & ~F.col("o.kind").isin(*D.LOOSE_BARRED))
    return _out(near.unionByName(loose.select("ref_id", F.col("o.id").alias("target"), F.lit(lo).alias("c"))), F.col("c"), strategy)


def scoped_calls(refs: DataFrame, nodes: DataFrame, mappings: DataFrame) -> DataFrame:
    """Calls by name within what their file can see: its own definitions and those whose top
    owner it imports; a script without imports sees the file-level definitions of other scripts,
    as long as one file alone has the name."""
    r = refs.where((F.col("reference_kind") == "calls") & F.col("reference_name").isNotNull())
    r = r.select("ref_id", "project_id", "reference_kind", F.col("reference_name").alias("name"), F.col("file_path").alias("r_path"), "language")
    n = nodes.select("id", "project_id", "kind", "name", "file_path", "qualified_name", P.top_owner("qualified_name").alias("top"))
    cols = ["ref_id", "reference_kind", "r_path", "id", "kind", "file_path"]
    own = r.join(n.withColumn("r_path", F.col("file_path")), ["project_id", "name", "r_path"]).select(*cols)
    seen = mappings.where(F.col("exported_name") != "").select("project_id", F.col("file_path").alias("r_path"), F.col("exported_name").alias("top")).distinct()
    imported = r.join(seen, ["project_id", "r_path"]).join(n, ["project_id", "name", "top"]).select(*cols)
    script = F.lower("language") == "javascript"
    alone = r.where(script).join(mappings.select("project_id", F.col("file_path").alias("r_path")).distinct(), ["project_id", "r_path"], "left_anti").join(own.select("ref_id"), "ref_id", "left_anti")
    level = n.where(F.lower("file_path").rlike(r"\.m?js$") & (F.substring_index("qualified_name", "::", -1) == F.col("name")))
    one = level.groupBy("project_id", "name").agg(F.count_distinct("file_path").alias("_f"), F.min(F.struct("id", "kind", "file_path")).alias("g")).where(F.col("_f") == 1)
    shared = alone.join(one, ["project_id", "name"]).select("ref_id", "reference_kind", "r_path", "g.id", "g.kind", "g.file_path")
    return _nearest(own.unionByName(imported).unionByName(shared), 0.9, 0.6, "scoped")


def scoped_handlers(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Template handlers that their own file defines (others bind by name)."""
    r = refs.where(F.col("reference_kind") == "handles").select("ref_id", "project_id", "reference_kind", F.col("reference_name").alias("name"), F.col("file_path").alias("r_path"))
    n = nodes.select("id", "project_id", "kind", "name", "file_path", F.col("file_path").alias("r_path"))
    return _nearest(r.join(n, ["project_id", "name", "r_path"]).select("ref_id", "reference_kind", "r_path", "id", "kind", "file_path"), 0.9, 0.6, "scoped")


def scoped_routes(refs: DataFrame, steer: DataFrame, nodes: DataFrame, mappings: DataFrame) -> DataFrame:
    """Route handlers inside the module that the URL file imports their receiver from, else what
    the file defines or imports itself."""
    r = refs.where(F.col("reference_kind") == "routes_to").join(steer.select("ref_id", "plain"), "ref_id", "left")
    r = r.select("ref_id", "project_id", "reference_kind", F.col("reference_name").alias("name"), F.col("file_path").alias("r_path"), F.split(F.coalesce("plain", F.lit("")), r"\.")[0].alias("receiver"))
    n = nodes.select("id", "project_id", "kind", "name", "file_path", P.dotted_module("file_path").alias("dotted"), P.top_owner("qualified_name").alias("top"))
    m = mappings.select("project_id", F.col("file_path").alias("r_path"), F.col("local_name").alias("receiver"), "source", "exported_name")
    via = r.join(m, ["project_id", "r_path", "receiver"])
    package = F.replace(P.directory(P.forward("r_path")), F.lit("/"), F.lit("."))
    base = F.when(F.col("source").startswith("."), F.concat_ws(".", F.nullif(package, F.lit("")), F.nullif(F.regexp_replace("source", r"^\.+", ""), F.lit("")))).otherwise(F.col("source"))
    via = via.withColumn("dotted", F.concat_ws(".", base, F.nullif("exported_name", F.lit(""))))
    cols = ["ref_id", "reference_kind", "r_path", "id", "kind", "file_path"]
    inside = via.join(n, ["project_id", "name", "dotted"]).select(*cols)
    rest = r.join(via.select("ref_id"), "ref_id", "left_anti")
    own = rest.join(n.withColumn("r_path", F.col("file_path")), ["project_id", "name", "r_path"]).select(*cols)
    seen = m.where(F.col("exported_name") != "").select("project_id", "r_path", F.col("exported_name").alias("top")).distinct()
    imported = rest.join(seen, ["project_id", "r_path"]).join(n, ["project_id", "name", "top"]).select(*cols)
    return _nearest(inside.unionByName(own).unionByName(imported), 0.9, 0.6, "scoped")


# Endings of class names and the folders where their definitions conventionally lie.
CONVENTIONS = (("(View|ViewSet)$", ("class", "function", "view"), ("views", "/api/")), ("Form$", ("class",), ("forms",)), ("Model$|^[A-Z][a-z]+$", ("class", "model"), ("models",)))


def conventions(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Python names bound by the framework's folders: the sole candidate of the kinds, else the
    first in a conventional folder (0.8)."""
    r = refs.where(F.lower("language").isin("py", "python") & F.col("reference_name").isNotNull())
    rule = F.coalesce(*[F.when(F.col("reference_name").rlike(rx), F.lit(i)) for i, (rx, _, _) in enumerate(CONVENTIONS)])
    r = r.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("ref_id", "project_id", F.col("reference_name").alias("name"), "rule")
    out = None
    for i, (_, kinds, folders) in enumerate(CONVENTIONS):
        at = F.col("file_path").rlike("|".join(folders))
        g = nodes.where(F.col("kind").isin(*kinds)).groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("any"), F.min(F.when(at, F.col("id"))).alias("placed"))
        hit = r.where(F.col("rule") == i).join(g, ["project_id", "name"]).select("ref_id", F.when(F.col("n") == 1, F.col("any")).otherwise(F.col("placed")).alias("target"))
        found = _out(hit.where(F.col("target").isNotNull()), 0.8, "framework")
        out = found if out is None else out.unionByName(found)
    return out


def companion_methods(refs: DataFrame, steer: DataFrame, nodes: DataFrame, flag: str, suffixes: tuple[str, ...], ends: tuple[str, ...], builtins: tuple[str, ...]) -> DataFrame:
    """Calls on a queryset or service: the sole method of that name on such a class (0.85), else
    the sole one whose class is the model's name with a known suffix (0.8)."""
    owner = P.top_owner("qualified_name")
    m = nodes.where((F.col("kind") == "method") & owner.rlike("(" + "|".join(ends) + ")$")).select("id", "project_id", F.col("name").alias("reference_name"), owner.alias("owner"))
    r = refs.where(F.col("reference_kind") == "calls").join(steer.where(F.col(flag)).select("ref_id", "plain"), "ref_id")
    sole = r.where(~F.col("reference_name").isin(*builtins)).join(_unique(m, "project_id", "reference_name"), ["project_id", "reference_name"])
    first = _out(sole, 0.85, flag)
    named = r.join(first.select("ref_id"), "ref_id", "left_anti").where(F.col("plain").isNotNull())
    named = named.select("ref_id", "project_id", "reference_name", F.explode(F.array(*[F.concat("plain", F.lit(x)) for x in suffixes])).alias("owner"))
    hit = named.join(m.groupBy("project_id", "reference_name", "owner").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("target")), ["project_id", "reference_name", "owner"])
    one = hit.groupBy("ref_id").agg(F.sum("c").alias("n"), F.min("target").alias("target")).where(F.col("n") == 1)
    return first.unionByName(_out(one, 0.8, flag))


def typed_receivers(refs: DataFrame, steer: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls on a value of a known type: the sole method of the type in the same language (0.9)."""
    m = nodes.where(F.col("kind").isin("method", "function")).select("id", "project_id", F.col("name").alias("reference_name"), P.top_owner("qualified_name").alias("plain"), F.col("language"))
    r = refs.where(F.col("reference_kind") == "calls").join(steer.where(F.col("typed") & F.col("plain").isNotNull()).select("ref_id", "plain"), "ref_id")
    r = r.withColumn("language", F.when(F.lower("language").isin("py", "python"), "python").otherwise(F.lower("language")))
    return _out(r.join(_unique(m, "project_id", "reference_name", "plain", "language"), ["project_id", "reference_name", "plain", "language"]), 0.9, "typed")


def instance_methods(refs: DataFrame, candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls with candidate classes: the first ``Class.method`` that exists, up to a mark (0.95)."""
    first_mark = candidates.where(F.col("item").startswith(MARK)).groupBy("ref_id").agg(F.min("pos").alias("stop"))
    c = candidates.join(first_mark, "ref_id", "left").where(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    r = refs.where(F.col("reference_kind") == "calls").select("ref_id", "project_id", "reference_name").join(c.select("ref_id", "pos", "item"), "ref_id")
    r = r.withColumn("qualified_name", F.concat("item", F.lit("."), "reference_name"))
    m = nodes.where(F.col("kind").isin("method", "function")).groupBy("project_id", "qualified_name").agg(F.min("id").alias("target"))
    best = r.join(m, ["project_id", "qualified_name"]).groupBy("ref_id").agg(F.min(F.struct("pos", "target")).alias("b"))
    return _out(best.select("ref_id", F.col("b.target").alias("target")), 0.95, "instance")


def import_mappings(content: DataFrame) -> DataFrame:
    """``(project_id, file_path, local_name, exported_name, source)`` from Python's import lines.

    In the JVM: lines, then the imported names with their aliases.
    """
    text = F.regexp_replace("content", r"\r\n?", "\n")
    rows = content.where(F.lower("file_path").endswith(".py")).select("project_id", "file_path", text.alias("t"))
    part = lambda rx, i: F.regexp_extract_all("t", F.lit(rx), F.lit(i))
    # names in brackets run over lines
    rx = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n]*)"
    both = F.arrays_zip(part(rx, 1).alias("source"), part(rx, 2).alias("names"))
    got = rows.select("project_id", "file_path", F.explode(both).alias("f")).select("project_id", "file_path", "f.source", "f.names")
    bare = F.regexp_replace(F.regexp_replace("names", r"#[^\n]*", ""), "[()]", " ")
    got = got.select("project_id", "file_path", "source", F.explode(F.split(bare, ",")).alias("x"))
    plain = rows.select("project_id", "file_path", F.explode(part(r"(?m)^[ \t]*import[ \t]+([\w.][^\n]*)", 1)).alias("names"))
    plain = plain.select("project_id", "file_path", F.explode(F.split(F.regexp_replace("names", "#.*$", ""), ",")).alias("x"))
    name = F.regexp_extract("x", r"^\s*([\w.]+)", 1)
    alias = F.regexp_extract("x", r"\sas\s+(\w+)", 1)
    a = got.select("project_id", "file_path", F.when(alias != "", alias).otherwise(name).alias("local_name"), name.alias("exported_name"), "source")
    b = plain.select("project_id", "file_path", F.when(alias != "", alias).otherwise(name).alias("local_name"), F.lit("").alias("exported_name"), name.alias("source"))
    return a.unionByName(b).where(F.col("local_name") != "").distinct()


def via_imports(refs: DataFrame, mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names that a file imported: the exported definition in a file named as the module's last
    part, else its sole definition (0.8)."""
    m = mappings.where(F.col("exported_name") != "").groupBy("project_id", "file_path", F.col("local_name").alias("reference_name")).agg(F.min(F.struct("exported_name", "source")).alias("m"))
    r = refs.join(m, ["project_id", "file_path", "reference_name"]).select("ref_id", "project_id", F.col("m.exported_name").alias("name"), F.substring_index("m.source", ".", -1).alias("stem"))
    n = nodes.where(~F.col("kind").isin("import", "external")).select("id", "project_id", "name", P.file_stem("file_path").alias("stem"))
    placed = r.join(n.groupBy("project_id", "name", "stem").agg(F.min("id").alias("target")), ["project_id", "name", "stem"])
    sole = r.join(placed.select("ref_id"), "ref_id", "left_anti").join(_unique(n, "project_id", "name"), ["project_id", "name"])
    return _out(placed.select("ref_id", "target").unionByName(sole.select("ref_id", "target")), 0.8, "import-alias")


def imports(refs: DataFrame, steer: DataFrame, nodes: DataFrame, mappings: DataFrame | None = None, hops: int = 8) -> DataFrame:
    """Pending imports: the definition in the module's file (0.9), through re-exports (0.8), the
    module's own file (0.85), a file of that name (0.85, relative imports), the sole definition
    of the name (0.8)."""
    r = refs.where(F.col("reference_kind") == "imports").join(steer.select("ref_id", "plain"), "ref_id", "left")
    r = r.select("ref_id", "project_id", F.col("reference_name").alias("name"), F.coalesce("plain", F.lit("")).alias("module"))
    r = r.withColumn("stem", F.substring_index("module", ".", -1))
    n = nodes.where(~F.col("kind").isin("import", "external")).select("id", "project_id", "name", "kind", "file_path", P.file_stem("file_path").alias("stem"))
    placed = r.where(F.col("stem") != "").join(n.groupBy("project_id", "name", "stem").agg(F.min("id").alias("target")), ["project_id", "name", "stem"])
    out = [(1, _out(placed, 0.9, "import"))]
    if mappings is not None:
        out.append((2, _out(reexports(r, mappings, n, hops), 0.8, "re-export")))
    file_ = n.where(F.col("kind") == "file").select("id", "project_id", P.dotted_module("file_path").alias("dotted"), "stem")
    # a module's file by every dotted ending of its path, so the suffix match is an equality
    endings = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dotted", r"\."))), lambda i: F.array_join(F.slice(F.split("dotted", r"\."), -i, i), ".")))
    by_end = file_.select("id", "project_id", endings.alias("dotted")).groupBy("project_id", "dotted").agg(F.min("id").alias("target"))
    whole = r.where(~F.col("module").startswith(".")).withColumn("dotted", F.concat_ws(".", F.nullif("module", F.lit("")), "name"))
    out.append((3, _out(whole.join(by_end, ["project_id", "dotted"]), 0.85, "module-file")))
    near = file_.groupBy("project_id", F.col("stem").alias("name")).agg(F.min("id").alias("target"))
    out.append((4, _out(r.where(F.col("module").startswith(".")).join(near, ["project_id", "name"]), 0.85, "relative-file")))
    out.append((5, _out(r.where(F.col("module").startswith(".")).join(_unique(n, "project_id", "name"), ["project_id", "name"]), 0.8, "sole")))
    return prefer(out)


def reexports(r: DataFrame, mappings: DataFrame, n: DataFrame, hops: int = 8) -> DataFrame:
    """``(ref_id, target)`` of imports from packages that pass a name on, followed up to ``hops``."""
    pack = mappings.where(F.col("file_path").endswith("__init__.py") & (F.col("exported_name") != "")).select(
        "project_id", P.dotted_module("file_path").alias("at"), F.col("local_name").alias("name"), F.col("exported_name"), F.col("source")
    )
    # a relative source lies in the package itself
    pack = pack.withColumn("to", F.when(F.col("source").startswith("."), F.concat("at", F.lit("."), F.regexp_replace("source", r"^\.+", ""))).otherwise(F.col("source")))
    pack = pack.groupBy("project_id", "at", "name").agg(F.min(F.struct("exported_name", "to")).alias("m")).select("project_id", "at", "name", F.col("m.exported_name").alias("en"), F.col("m.to").alias("to"))
    defs = n.select("project_id", "name", P.dotted_module("file_path").alias("at"), "id").groupBy("project_id", "name", "at").agg(F.min("id").alias("target"))
    at = r.select("ref_id", "project_id", "name", F.col("module").alias("at"))
    found = None
    for _ in range(hops):
        at = at.join(pack, ["project_id", "at", "name"]).select("ref_id", "project_id", F.col("en").alias("name"), F.col("to").alias("at"))
        hit = at.join(defs, ["project_id", "name", "at"]).select("ref_id", "target")
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("ref_id").agg(F.min("target").alias("target"))


def prefer(ranked: list[tuple[int, DataFrame]]) -> DataFrame:
    """Of several strategies' outputs each reference's first, by priority."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("_p", F.lit(p)) for p, df in ranked])
    best = rows.groupBy("ref_id").agg(F.min(F.struct("_p", "target", "confidence", "strategy")).alias("b"))
    return best.select("ref_id", "b.target", "b.confidence", "b.strategy")


def resolve(refs: DataFrame, candidates: DataFrame, nodes: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """``(ref_id, target, confidence, strategy)`` of all references that bind.

    ``mappings``: the imports of files; with them calls and route handlers bind only to what
    their file can see. Kinds of later passes stay pending; imports have their own ways; a dispatched call binds by
    its dispatch or not at all; super calls never bind here; a reference to itself is dropped.
    """
    scratch = Scratch(refs.sparkSession, "resolve")
    # each input is read by several strategies: written once, their plans stay small
    keep = lambda df: scratch.keep(scratch.write(df))
    refs = keep(refs.select("ref_id", "project_id", "from_node_id", "reference_name", "reference_kind", "file_path", "language"))
    nodes = keep(nodes.select("id", "project_id", "kind", "name", "qualified_name", "file_path", "language"))
    candidates = keep(candidates)
    mappings = keep(mappings) if mappings is not None else None
    steer = keep(steering(candidates))
    live = refs.where(~F.col("reference_kind").isin(*D.PIPELINE_KINDS) & F.col("reference_name").isNotNull())
    marked = steer.where(F.col("queryset") | F.col("service") | F.col("typed")).select("ref_id")
    barred = steer.where(F.col("super_")).select("ref_id")
    names = live.where(F.col("reference_kind") != "imports").join(barred, "ref_id", "left_anti")
    # dispatched calls never fall through to names
    calls = names.where(F.col("reference_kind") == "calls")
    plain = names.where(F.col("reference_kind") != "calls").unionByName(calls.join(marked, "ref_id", "left_anti"))
    q = steer.withColumn("service", F.col("service") & ~F.col("queryset")).withColumn("typed", F.col("typed") & ~F.col("queryset") & ~F.col("service"))
    ways = [
        (1, companion_methods(names, q, nodes, "queryset", MANAGERS, ("QuerySet", "Manager"), D.QUERYSET_BUILTINS)),
        (2, companion_methods(names, q, nodes, "service", SERVICES, ("Service",), SERVICE_BUILTINS)),
        (3, typed_receivers(names, q, nodes)),
        (4, instance_methods(plain, candidates, nodes)),
        (5, scoped_handlers(plain, nodes)),
        (10, imports(live, steer, nodes, mappings)),
    ]
    wide = plain
    if mappings is not None:
        # what a file can see bounds calls and routes; without mappings all names are visible
        ways += [(6, scoped_calls(plain, nodes, mappings)), (6, scoped_routes(plain, steer, nodes, mappings)), (8, via_imports(plain, mappings, nodes))]
        wide = plain.where(~F.col("reference_kind").isin("calls", "routes_to"))
    ways += [(7, by_locality(wide, nodes, languages=True)), (9, by_locality(wide, nodes, True, True)), (11, conventions(plain, nodes))]
    out = prefer([(p, keep(df)) for p, df in ways])
    return out.join(refs.select("ref_id", "from_node_id"), "ref_id").where(~F.col("target").eqNullSafe(F.col("from_node_id"))).select(*OUT)


def _marks(texts: DataFrame, text: str) -> DataFrame:
    """``(name, marks)``: per name the lengths and first characters of its texts, at most as many
    as lengths times characters, however many texts there are."""
    mark = F.struct(F.length(text).alias("n"), F.substr(text, F.lit(1), F.lit(1)).alias("c"))
    return texts.where(F.length(text) > 0).groupBy("name").agg(F.collect_set(mark).alias("marks"))


def _endings(text: Column, marks: Column) -> Column:
    """A text's endings, itself among them, that have one of the lengths with its first character."""
    at = lambda m: F.length(text) - m["n"] + 1
    fit = F.filter(marks, lambda m: (at(m) > 0) & (F.substr(text, at(m), F.lit(1)) == m["c"]))
    return F.transform(fit, lambda m: F.substr(text, at(m)))


def by_module(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked(name, module, ...)`` with the ``nodes(name, file_path, ...)`` of that name whose
    dotted path and module match: one is an ending of the other.

    An ending is looked up by equality, together with the name, so a name that all modules share
    pairs no module with definitions elsewhere. Only endings are made that by length and first
    character may be there. A pair that matches both ways comes once.
    """
    n = nodes.withColumn("_d", P.dotted_module("file_path"))
    held = n.join(_marks(asked, "module"), "name").select(*n.columns, F.explode(_endings(F.col("_d"), F.col("marks"))).alias("module"))
    down = asked.join(held, ["name", "module"])
    up = asked.join(_marks(n, "_d"), "name").select(*asked.columns, F.explode(_endings(F.col("module"), F.col("marks"))).alias("_d")).where(F.col("_d") != F.col("module"))
    return down.unionByName(up.join(n, ["name", "_d"])).drop("_d")


def link_projects(refs: DataFrame, steer: DataFrame | None, nodes: DataFrame, reference_only: DataFrame | None = None) -> DataFrame:
    """Imports to definitions of other projects: by module path (0.85), else the sole one in the
    project that is the module's first package (0.8). Generated files are no targets.

    ``steer`` is None where ``refs`` have their ``plain`` already. What a name and module lead to
    is found once for all projects: the smallest definition and the smallest of another project
    than that one's answer any of them. Both inputs are read several times, so they are written
    when this is called.
    """
    n = nodes.where(F.col("kind").isin(*D.LINKABLE_KINDS) & ~P.is_generated_path("file_path") & F.col("project_id").isNotNull()).select("id", F.col("project_id").alias("to"), "name", "file_path")
    if reference_only is not None:
        n = n.join(reference_only.select(F.col("id").alias("to")), "to", "left_anti")
    r = refs.where((F.col("reference_kind") == "imports") & F.col("reference_name").isNotNull())
    if steer is not None:
        r = r.join(steer.select("ref_id", "plain"), "ref_id")
    r = r.where(F.col("plain").isNotNull()).select("ref_id", "project_id", F.col("reference_name").alias("name"), F.col("plain").alias("module"))
    scratch = Scratch(refs.sparkSession, "links")
    n, r = (scratch.keep(scratch.write(df)) for df in (n, r))
    asked = r.select("name", "module").distinct()
    per = by_module(asked, n).groupBy("name", "module", "to").agg(F.min("id").alias("id"))
    rank = F.row_number().over(Window.partitionBy("name", "module").orderBy("id", "to"))
    nth = lambda k: F.max(F.when(F.col("_k") == k, F.struct("to", "id")))
    two = per.withColumn("_k", rank).where(F.col("_k") <= 2).groupBy("name", "module").agg(nth(1).alias("lo"), nth(2).alias("hi"))
    sole = n.groupBy("to", "name").agg(F.min("id").alias("sole"), F.max("id").alias("_m")).where(F.col("sole") == F.col("_m")).drop("_m")
    packaged = asked.withColumn("to", F.substring_index("module", ".", 1)).join(sole, ["to", "name"])
    hit = r.join(two, ["name", "module"], "left").join(packaged, ["name", "module"], "left")
    own = F.col("project_id")
    hit = hit.withColumn("first", F.when(F.col("lo.to") != own, F.col("lo.id")).when(F.col("lo.to") == own, F.col("hi.id")))
    hit = hit.withColumn("target", F.coalesce("first", F.when(F.col("to") != own, F.col("sole")))).where(F.col("target").isNotNull())
    by_path = F.col("first").isNotNull()
    return hit.select("ref_id", "target", F.when(by_path, 0.85).otherwise(0.8).alias("confidence"), F.when(by_path, "link-module").otherwise("link-package").alias("strategy"))


def link_names(refs: DataFrame, nodes: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """References of given kinds to the sole match of their name in other projects (0.8).

    ``kinds``: per reference kind the node kinds that may be its target. The count over other
    projects is the total less that of the own project: two aggregates and no pairs.
    """
    out = None
    for ref_kind, targets in kinds.items():
        n = nodes.where(F.col("kind").isin(*targets)).select("id", "project_id", F.col("name").alias("reference_name"))
        per = n.groupBy("reference_name", "project_id").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("target"))
        # only a project with one definition can answer; with the own one aside at most one is left,
        # so the first and the last of them are enough
        single = F.when(F.col("c") == 1, F.struct("project_id", "target"))
        total = per.groupBy("reference_name").agg(F.sum("c").alias("all"), F.min(single).alias("lo"), F.max(single).alias("hi"))
        r = refs.where(F.col("reference_kind") == ref_kind).select("ref_id", "project_id", "reference_name")
        own = r.join(per.select("reference_name", "project_id", F.col("c").alias("own")), ["reference_name", "project_id"], "left")
        hit = own.join(total, "reference_name").where(F.col("all") - F.coalesce("own", F.lit(0)) == 1)
        other = F.when(F.col("lo.project_id") != F.col("project_id"), F.col("lo.target")).otherwise(F.col("hi.target"))
        found = _out(hit.select("ref_id", other.alias("target")).where(F.col("target").isNotNull()), 0.8, f"link-{ref_kind}")
        out = found if out is None else out.unionByName(found)
    return out


def redirects(nodes: DataFrame) -> DataFrame:
    """``(stub, target)``: external stubs whose definition a project has exactly once, by the
    stub's qualified name (its module must match the definition's file)."""
    stubs = nodes.where(F.col("kind") == "external").select(F.col("id").alias("stub"), "name", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("module"))
    n = nodes.where(F.col("kind").isin(*D.LINKABLE_KINDS)).select("id", "name", "file_path")
    return by_module(stubs, n).groupBy("stub").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).where(F.col("n") == 1).select("stub", "target")


def inherited_calls(refs: DataFrame, edges: DataFrame, nodes: DataFrame, inherited: DataFrame) -> DataFrame:
    """Calls that only an inherited method answers: by the caller's class (0.85).

    ``inherited(cls, name, method)`` of :func:`symgraph.operators.graph.inherited_methods`.
    """
    owner = edges.where(F.col("kind") == "contains").groupBy(F.col("target").alias("from_node_id")).agg(F.min("source").alias("cls"))
    r = refs.where(F.col("reference_kind") == "calls").join(owner, "from_node_id").select("ref_id", "cls", F.col("reference_name").alias("name"))
    return _out(r.join(inherited.withColumnRenamed("method", "target"), ["cls", "name"]), 0.85, "inherited")


def receiver_calls(refs: DataFrame, receivers: DataFrame, edges: DataFrame, nodes: DataFrame, inherited: DataFrame) -> DataFrame:
    """Calls on a receiver of a known class ``receivers(ref_id, cls)``: the class's own sole method
    of the name, else the inherited one that answers it (0.85).

    The class may come from the receiver's type (:func:`typed_classes`), from a relation it is
    (:func:`related_classes`) or from what its file imported (:func:`imported_classes`); of several
    claims none counts.
    """
    held = edges.where(F.col("kind") == "contains").select(F.col("source").alias("cls"), F.col("target").alias("id")).distinct()
    own = held.join(nodes.where(F.col("kind") == "method").select("id", "name"), "id").groupBy("cls", "name").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("target"))
    every = own.where("c = 1").select("cls", "name", "target").unionByName(inherited.select("cls", "name", F.col("method").alias("target")).join(own, ["cls", "name"], "left_anti"))
    r = refs.where(F.col("reference_kind") == "calls").select("ref_id", F.col("reference_name").alias("name"))
    return _out(r.join(unique_claims(receivers, ["ref_id"], "cls"), "ref_id").join(every, ["cls", "name"]), 0.85, "receiver")


def _sole_classes(nodes: DataFrame) -> DataFrame:
    """``(project_id, name, cls)``: classes that alone have their name in a project."""
    c = nodes.where(F.col("kind").isin("class", "model")).select("project_id", "name", "id")
    return c.groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("cls")).where("c = 1").drop("c")


def typed_classes(refs: DataFrame, steer: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(ref_id, cls)``: the receiver's type by its name, where one class of the project has it."""
    r = refs.select("ref_id", "project_id").join(steer.where(F.col("typed") & F.col("plain").isNotNull()).select("ref_id", F.substring_index("plain", ".", -1).alias("name")), "ref_id")
    return r.join(_sole_classes(nodes), ["project_id", "name"]).select("ref_id", "cls")


def related_classes(refs: DataFrame, steer: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(ref_id, cls)``: ``Owner.accessor`` receivers by ``relations(owner, accessor, related)``."""
    r = refs.select("ref_id", "project_id").join(steer.where(F.col("plain").contains(".")).select("ref_id", "plain"), "ref_id")
    r = r.select("ref_id", "project_id", F.element_at(F.split("plain", r"\."), -2).alias("owner"), F.substring_index("plain", ".", -1).alias("accessor"))
    to = r.join(relations, ["owner", "accessor"]).select("ref_id", "project_id", F.col("related").alias("name"))
    return to.join(_sole_classes(nodes), ["project_id", "name"]).select("ref_id", "cls")


def imported_classes(refs: DataFrame, steer: DataFrame, mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(ref_id, cls)``: receivers that their file imported, by the exported name."""
    r = refs.select("ref_id", "project_id", "file_path").join(steer.where(F.col("plain").isNotNull()).select("ref_id", F.substring_index("plain", ".", 1).alias("local_name")), "ref_id")
    m = unique_claims(mappings.where(F.col("exported_name") != ""), ["project_id", "file_path", "local_name"], "exported_name")
    return r.join(m, ["project_id", "file_path", "local_name"]).withColumnRenamed("exported_name", "name").join(_sole_classes(nodes), ["project_id", "name"]).select("ref_id", "cls")


def unique_claims(claims: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with one distinct value; conflicting claims are void."""
    g = claims.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value))
    return g.where(F.col("_n") == 1).drop("_n")


def externals(refs: DataFrame, mappings: DataFrame, first_party: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(stubs, edges)``: pending references to names imported from foreign packages.

    ``first_party(package)``: roots that belong to the projects. Edges are distinct.
    """
    m = mappings.where(~F.col("source").startswith(".")).withColumn("package", F.substring_index("source", ".", 1)).join(first_party.select("package"), "package", "left_anti")
    m = m.groupBy("project_id", "file_path", F.col("local_name").alias("reference_name")).agg(F.min(F.struct("source", "exported_name")).alias("m"))
    hit = refs.join(m, ["project_id", "file_path", "reference_name"])
    q = F.concat_ws(".", "m.source", F.nullif("m.exported_name", F.lit("")))
    edges = hit.select(F.col("from_node_id").alias("source"), F.concat(F.substring_index("m.source", ".", 1), F.lit("::"), q).alias("target"), F.col("reference_kind").alias("kind"), q.alias("qualified_name")).distinct()
    stubs = edges.select(F.col("target").alias("id"), "qualified_name", F.substring_index("qualified_name", ".", -1).alias("name")).distinct()
    return stubs, edges.select("source", "target", "kind", F.lit("external").alias("provenance"))


def template_members(accesses: DataFrame, contexts: DataFrame, loops: DataFrame, accessors: DataFrame, ancestry: DataFrame, members: DataFrame) -> DataFrame:
    """``(template, path, target)``: member accesses in templates bound through their context.

    ``accesses(template, head, attr)``; ``contexts(node, name, model, many)`` of views and
    templates; ``loops(template, item, over)``: the loop variable and what it runs over (a name
    or ``obj.accessor``); ``accessors(model, accessor, related)``; ``ancestry(template,
    ancestor)``; ``members(model, name, target)``. A head must have one model and that model one
    member of the name, otherwise the access stays unbound.
    """
    scope = ancestry.select("template", F.col("ancestor").alias("node")).unionByName(ancestry.select("template", F.col("template").alias("node"))).distinct()
    known = scope.join(contexts, "node").select("template", "name", "model", "many").distinct()
    single = known.where(~F.col("many")).select("template", F.col("name").alias("head"), "model")
    plain = loops.where(~F.col("over").contains(".")).join(known.where("many"), (loops["template"] == known["template"]) & (loops["over"] == known["name"])).select(loops["template"], F.col("item").alias("head"), "model")
    dotted = loops.where(F.col("over").contains(".")).select("template", "item", F.substring_index("over", ".", 1).alias("head"), F.substring_index("over", ".", -1).alias("accessor"))
    through = dotted.join(single, ["template", "head"]).join(accessors, ["model", "accessor"]).select("template", F.col("item").alias("head"), F.col("related").alias("model"))
    heads = unique_claims(single.unionByName(plain).unionByName(through).distinct(), ["template", "head"], "model")
    sole = members.groupBy("model", F.col("name").alias("attr")).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where(F.col("n") == 1)
    return accesses.join(heads, ["template", "head"]).join(sole, ["model", "attr"]).select("template", F.concat("head", F.lit("."), "attr").alias("path"), "target").distinct()


def namespaced_reverses(refs: DataFrame, routes: DataFrame, chains: DataFrame) -> DataFrame:
    """``resolves`` references to routes by their reverse name: with its namespaces, else bare.

    ``routes(id, name, module)``, ``chains(node, chain)``: the namespaces above each URL module.
    """
    named = routes.join(chains.select(F.col("node").alias("module"), "chain"), "module", "left").select("id", F.col("name").alias("bare"), F.concat_ws(":", F.nullif("chain", F.lit("")), "name").alias("reference_name"))
    r = refs.where(F.col("reference_kind") == "resolves").select("ref_id", "reference_name")
    full = r.join(_unique(named, "reference_name"), "reference_name")
    bare = r.join(full.select("ref_id"), "ref_id", "left_anti").withColumn("bare", F.substring_index("reference_name", ":", -1)).join(_unique(named, "bare"), "bare")
    return _out(full.select("ref_id", "target"), 0.9, "reverse").unionByName(_out(bare.select("ref_id", "target"), 0.6, "reverse-bare"))
