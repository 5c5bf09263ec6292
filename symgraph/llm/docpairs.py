"""Functions paired with their documentation.

Method: documentation is parsed into free text and tags, and kept if any of it describes
something. A method without such documentation may inherit it: its overridden method is found
from ``overrides`` links or by climbing the class hierarchy (``extends`` links, level by level
up to a method of the same name), and the pointers to overridden methods are followed by
doubling until they meet documentation; what meets none is dropped. Source lines come from a
join of the resolved nodes with their file.

Defined results: null or blank documentation describes nothing; nodes with null spans, or whose
file is not there, pair with null code; duplicates and outdated versions of a node count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Growing, Scratch
from ..sources.tables import latest_nodes, left_join, norm_kind

# Texts that stand where documentation should be (lower case, without punctuation).
PLACEHOLDERS = frozenset(
    """
tbd|tba|tbc|todo|fixme|xxx|hack|na|n a|none|null|nil|docstring|doc|docs|description|desc|summary|placeholder|comment|no description|no docs
no documentation|no docstring|undocumented|not documented|documentation missing|missing documentation|missing docstring|docstring missing
description missing|missing description|add description|add description here|add docs|add docs here|add documentation|add documentation here
write docs|write documentation|document me|document this|to be documented|to be done|to be defined|to do|to be written|to be completed
no comment|nothing|nothing here|empty|insert description|insert description here|your description here|description goes here|lorem ipsum
description here|docs here|short description|brief description|docstring here|stub|dummy|unknown|coming soon|work in progress|wip|pending
beschreibung|keine beschreibung|dokumentation fehlt|description à compléter|à compléter|pas de description|sin descripción|por hacer|sem descrição|a fazer
""".replace("\n", "|").strip("|").split("|")
)
_LATER = re.compile(r"^[\s\[(@]*(?:todo|fixme|xxx|hack|tbd)\b", re.I)
_POINTER = re.compile(
    r"^\W*(?:@?inherit(?:ed)?(?:[-_ ]?doc)?(?:s|umentation)?\b|\{@inheritdoc\}|same as\b|as above\b|see(?: also)?\b|refer to\b|cf\b|siehe\b|voir\b|véase\b|ver\b|ditto\b|copied from\b|documented (?:in|at|elsewhere)\b|overrid(?:es|den)\b)",
    re.I,
)
_LINTER = re.compile(
    r"^\W*(?:noqa\b|pylint\b|flake8\b|mypy\b|pyright\b|type:\s*ignore|pragma\b|eslint\b|eslint-|jshint\b|jslint\b|prettier-ignore|stylelint\b|ts-(?:ignore|nocheck|expect)|istanbul\b|c8 ignore|nosec\b|nolint\b|isort:|fmt:\s*(?:on|off)|yapf:|ruff\b|coverage\b:)",
    re.I,
)
_SECTION = re.compile(r"^\s*(?:args?|arguments|parameters?|params|returns?|yields?|raises|throws|exceptions?|attributes|examples?|notes?)\s*:?\s*$", re.I)
_ENTRY = re.compile(r"^\s*\*{0,2}[A-Za-z_][\w.]*\s*(?:\([^)]*\))?\s*:\s*(.*)$")
_TYPE_TAG = re.compile(r"^[:@\\](?:type|rtype|vartype)\b[^:]*:?.*$", re.I)
_FIELD = re.compile(r"^:(?:param|parameter|arg|argument|key|keyword|returns?|raises?|except|exception|yields?|var|ivar|cvar|meta)\b([^:]*):\s*(.*)$", re.I)
_AT = re.compile(r"^[@\\](\w+)\s*(.*)$")
_TYPE = re.compile(r"^(?:\{[^}]*\}|[\w.]+\[.*\]|none|null|void|bool(?:ean)?|str(?:ing)?|int(?:eger)?|float|number|object|dict|list|tuple|set|array|any|self|this|bytes|undefined|iterable|promise|callable|function)\.?$", re.I)
_CALL = re.compile(r"^(?:(?:async|def|function|func|fn)\s+)*([\w.$]+)\s*\(.*\)\s*(?:(?:->|:|=>).*)?[.;:]?$")
_WORDS = re.compile(r"[^\W_]+", re.UNICODE)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
# Words that add nothing to a name.
FILLERS = frozenset(
    "a an the this that these it its is are be was does do done to of for from in on with by and or as function functions method methods func def fn "
    "procedure routine helper utility implementation implements implement performs perform handles handle executes execute runs run calls call returns return "
    "class member callback here simply just operation action simple basic main".split()
)


def _strip_marks(doc: str) -> list[str]:
    """The lines without comment marks and wrapping quotes."""
    t = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    t = re.sub(r"^[rRuUbBfF]{0,2}(\"\"\"|''')", "", t)
    t = re.sub(r"(\"\"\"|''')$", "", t)
    t = re.sub(r"^/\*+!?", "", t)
    t = re.sub(r"\*+/$", "", t)
    t = re.sub(r"^<!--|-->$", "", t)
    out = []
    for x in t.split("\n"):
        x = re.sub(r"^\s*(?:\*(?!\*)\s?|#+\s?|//+[!/]?\s?|--\s)", "", x)
        out.append(x.strip().strip("\"'`").strip())
    return out


def _tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", text))]


def _stem(w: str) -> str:
    for s in ("ing", "ies", "es", "ed", "s"):
        if w.endswith(s) and len(w) - len(s) >= 3:
            return w[: -len(s)]
    return w


def says_something(text: str, known: set[str]) -> bool:
    """Whether one line of free or tag text describes anything beyond the ``known`` words."""
    t = text.strip()
    if not any(c.isalnum() for c in t):
        return False
    if _LATER.match(t) or _POINTER.match(t) or _LINTER.match(t):
        return False
    call = _CALL.match(t)
    if call and set(_tokens(call.group(1))) <= known:
        return False
    words = _tokens(t)
    if " ".join(words) in PLACEHOLDERS:
        return False
    rest = [w for w in words if w not in FILLERS and not w.isdigit()]
    if not rest:
        return False
    return any(w not in known and _stem(w) not in known for w in rest)


def describes(doc: str | None, name: str | None = None, signature: str | None = None) -> bool:
    """Whether a docstring describes something (text in a tag counts, a tag without text not)."""
    if not isinstance(doc, str) or not doc.strip():
        return False
    known = set(_tokens(name or "")) | set(_tokens(signature or ""))
    known |= {_stem(w) for w in known}
    section = False
    for line in _strip_marks(doc):
        if not line:
            continue
        if _SECTION.match(line):
            section = True
            continue
        if _TYPE_TAG.match(line):
            continue
        m = _FIELD.match(line)
        if m:
            text = m.group(2)
            if text and not _TYPE.match(text.strip()) and says_something(text, known | set(_tokens(m.group(1)))):
                return True
            continue
        m = _AT.match(line)
        if m and m.group(1).lower() not in ("generated",):
            tag, text = m.group(1).lower(), re.sub(r"^\{[^}]*\}\s*", "", m.group(2))
            if tag in ("type", "typedef", "private", "public", "protected", "static", "override", "async", "inheritdoc", "export", "abstract", "author", "see", "link"):
                continue
            if tag in ("param", "arg", "argument", "property", "prop", "template", "throws", "raises", "exception"):
                part = re.match(r"^(\[?[\w.$=]+\]?)\s*(?:[-:]\s*)?(.*)$", text)
                own, text = (set(_tokens(part.group(1))), part.group(2)) if part else (set(), text)
            else:
                own = set()
            if text and not _TYPE.match(text.strip()) and says_something(text, known | own):
                return True
            continue
        m = _ENTRY.match(line) if section else None
        if m:
            if m.group(1) and not _TYPE.match(m.group(1).strip()) and says_something(m.group(1), known | set(_tokens(line.split(":")[0]))):
                return True
            continue
        if section and _TYPE.match(line):
            continue
        if says_something(line, known):
            return True
    return False


def _flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        own = [describes(d, n, s) for d, n, s in zip(pdf["docstring"], pdf["name"], pdf["signature"])]
        yield pd.DataFrame({"id": pdf["id"], "kind": pdf["kind"], "name": pdf["name"], "own": own})


def _callables(nodes: DataFrame, *columns: str) -> DataFrame:
    held = latest_nodes(nodes, "kind", *columns)
    return held.withColumn("kind", norm_kind(F.col("kind"))).where(F.col("kind").isin("function", "method"))


def documented(nodes: DataFrame) -> DataFrame:
    """``(id, kind, name, own)`` of every function and method: whether its own documentation describes something."""
    held = _callables(nodes, "docstring", "name", "signature").select("id", "kind", "name", "docstring", "signature")
    return held.mapInPandas(_flag, "id string, kind string, name string, own boolean")


def overridden(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, base)``: the method that a method overrides, by link or by class hierarchy.

    The nearest level wins; on a level the smallest id. No class is climbed to twice, so rings end.
    """
    methods = _callables(nodes, "name").where(F.col("kind") == "method").select("id", "name")
    return _bases(methods, methods.select("id"), edges)


def _bases(methods: DataFrame, wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`overridden` of the ``wanted(id)`` among ``methods(id, name)``; a written table per level."""
    scratch = Scratch(methods.sparkSession, "overridden")
    e = edges.select(norm_kind(F.col("kind")).alias("kind"), "source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull())
    direct = e.where((F.col("kind") == "overrides") & (F.col("source") != F.col("target"))).groupBy(F.col("source").alias("id")).agg(F.min("target").alias("base"))
    direct = scratch.keep(scratch.write(direct))
    bases = scratch.keep(scratch.write(e.where(F.col("kind") == "extends").select(F.col("source").alias("cls"), F.col("target").alias("up")).distinct()))
    members = e.where(F.col("kind") == "contains").select(F.col("source").alias("cls"), F.col("target").alias("id")).distinct()
    members = scratch.keep(scratch.write(members.join(methods, "id").select("cls", "name", "id")))
    named = members.groupBy("cls", "name").agg(F.min("id").alias("base"), F.max("id").alias("_last"))
    # climb only where the way can lead further: the frontier shrinks with every level
    frontier = members.join(wanted, "id", "left_semi").join(direct.select("id"), "id", "left_anti").select("id", "name", "cls")
    climbed: Growing | None = None
    level = 0
    while True:
        level += 1
        up = frontier.join(bases, "cls").select("id", "name", F.col("up").alias("cls")).distinct()
        if climbed:
            up = up.join(climbed.df.select("id", "cls"), ["id", "cls"], "left_anti")
        # a class's own method of that name, but for the one that climbs
        other = F.when(F.col("base") != F.col("id"), F.col("base")).when(F.col("_last") != F.col("id"), F.col("_last"))
        step = up.join(named, ["cls", "name"], "left").select("id", "name", "cls", other.alias("base"), F.lit(level).alias("level"))
        if climbed is None:
            climbed, added = (g := Growing(scratch, step)), g.total
        else:
            added = climbed.add(step)
        if not added:
            break
        hits = climbed.last.where(F.col("base").isNotNull()).select("id").distinct()
        frontier = climbed.last.join(hits, "id", "left_anti").select("id", "name", "cls")
    found = climbed.keep().where(F.col("base").isNotNull()).select("id", "level", "base").unionByName(direct.withColumn("level", F.lit(0)))
    return found.groupBy("id").agg(F.min(F.struct("level", "base")).alias("m")).select("id", F.col("m.base").alias("base"))


def resolve_docs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, doc_from)``: the node whose documentation describes ``id``; unresolved are dropped.

    ``doc_from`` is the id itself, or the first documented method on its chain of overrides.
    """
    scratch = Scratch(nodes.sparkSession, "docs")
    flags = scratch.keep(scratch.write(documented(nodes)))
    done = flags.where("own").select("id", F.col("id").alias("doc_from"))
    silent = flags.where(~F.col("own"))
    open_ = silent.join(_bases(flags.where("kind = 'method'").select("id", "name"), silent.select("id"), edges), "id")
    state = scratch.write(
        open_.select("id", F.col("base").alias("ptr"))
        .join(flags.select(F.col("id").alias("ptr"), F.col("own").alias("hit")), "ptr", "left")
        .select("id", "ptr", F.coalesce("hit", F.lit(False)).alias("hit"))
    )
    before = -1
    while True:
        left = state.where(~F.col("hit")).count()
        if left in (0, before):
            break
        before = left
        seen = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("hit").alias("h2"))
        # a pointer at a method that overrides nothing stays where it is and ends unresolved
        moved = state.where(~F.col("hit")).join(seen, "ptr").select("id", F.col("p2").alias("ptr"), F.col("h2").alias("hit"))
        state = scratch.replace(state, state.where("hit").unionByName(moved))
    scratch.keep(state)
    return done.unionByName(state.where("hit").select("id", F.col("ptr").alias("doc_from")))


def pairs(nodes: DataFrame, edges: DataFrame, content: DataFrame) -> DataFrame:
    """``(id, qualified_name, kind, signature, code, docstring, doc_from, inherited)``.

    A file is split into lines once, before its functions meet it; each takes its lines out of
    that array within the join. A file with very many functions is a hot key of a join with a
    unique side, which adaptive execution splits.
    """
    held = _callables(nodes, "qualified_name", "project_id", "file_path", "signature", "start_line", "end_line", "docstring")
    found = resolve_docs(nodes, edges)
    inherits = F.col("id") != F.col("doc_from")
    # only inherited documentation is looked up
    given = found.where(inherits).join(held.select(F.col("id").alias("doc_from"), F.col("docstring").alias("given")), "doc_from").select("id", "doc_from", "given")
    docs = found.where(~inherits).select("id", "doc_from", F.lit(None).cast("string").alias("given")).unionByName(given)
    rows = held.join(docs, "id").withColumn("docstring", F.coalesce("given", "docstring"))
    texts = content.where(F.col("content").isNotNull()).groupBy("project_id", "file_path").agg(F.max("content").alias("content"))
    texts = texts.select("project_id", "file_path", F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n").alias("lines"))
    size = F.col("end_line") - F.col("start_line") + 1
    span = (F.col("start_line") >= 1) & (size >= 1)
    code = F.when(span, F.array_join(F.slice("lines", F.greatest("start_line", F.lit(1)), F.greatest(size, F.lit(1))), "\n"))
    return left_join(rows, texts, ["project_id", "file_path"], "id").select("id", "qualified_name", "kind", "signature", code.alias("code"), "docstring", "doc_from", inherits.alias("inherited"))
