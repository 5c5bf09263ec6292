"""Generated, minified, vendored and data files among source files.

Method: one pass over the contents, in which an automaton of all notice phrases runs over the
comment lines at the head and the foot of a file, joined with rules on the path (vendored
folders, lockfiles, minified and generated suffixes, numbered migrations) and with measures of
the text (line lengths and blanks for minified code, what is left without literals for data).
Only verdicts and a fingerprint leave the pass, never contents. A second step finds unmarked
copies: a file whose fingerprint (text without its first banner, line ends and outer blanks) is
that of a file in a vendored folder or under a third-party banner is a copy as well.

Reasons: ``notice``, ``migration``, ``suffix``, ``lockfile``, ``vendored``, ``banner``,
``minified``, ``data``, ``copy``.

Defined results: empty files and short package markers are never cases; a file without a content
is judged by its path; null paths are dropped; exact duplicates count once; of several contents
of one file one verdict is enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from ..sources.tables import left_join

# What generators write about their output. A comment line with one is a notice.
NOTICES = (
    "@generated",
    "<auto-generated",
    "autogenerated by",
    "auto-generated by",
    "auto-generated file",
    "autogenerated file",
    "automatically generated",
    "auto generated",
    "code generated by",
    "generated by the protocol",
    "generated code",
    "do not edit",
    "don't edit",
    "do not modify",
    "changes will be lost",
    "changes will be overwritten",
    "created by a tool",
    "machine generated",
    "machine-generated",
    "machine made",
    "machine-made",
    "edit the schema instead",
    "edit the source instead",
    "edit the template instead",
    "automatisch erzeugt",
    "automatisch generiert",
    "nicht bearbeiten",
    "généré automatiquement",
    "ne pas modifier",
    "generado automáticamente",
    "no editar",
    "gerado automaticamente",
    "não edite",
    "自動生成",
)
# They count only at the beginning of a comment and with a number (version, date).
OPENINGS = ("generated by", "generated on", "generated from", "created by", "compiled from", "compiled by")
# They turn a notice into its opposite.
DENIALS = ("not generated", "hand kept", "kept by hand", "hand-written", "handwritten", "never generated", "isn't generated")
# Folders of copies of third-party code, in lower case.
VENDORED = ("node_modules", "bower_components", "jspm_packages", "vendor", "third_party", "third-party", "thirdparty", "extern", "static_files", "staticfiles", "site-packages", "dist-packages")
# Lockfiles.
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "uv.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum")

_SUFFIX = re.compile(r"[._-](?:min|bundle|chunk)\.(?:js|mjs|css)$|_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:go|cc|h)$|\.generated\.\w+$|\.js\.map$|\.css\.map$")
_MIGRATION = re.compile(r"^\d{3,}_\w+\.py$")
_COMMENT = re.compile(r"^(?:#!?|//+!?|/\*+!?|\*+/?|<!--|\{#|--|;)")
_LICENCE = re.compile(r"@licen[cs]e|\blicen[cs]ed?\b|\b(?:mit|bsd|isc|apache|l?gpl|mpl)\b|\(c\)|copyright", re.I)
_RELEASE = re.compile(r"(?:\bv?|/)\d+\.\d+(?:\.\d+)?\b")
# a licence by name, and a name with its release at the beginning of a line
_TERMS = re.compile(r"@licen[cs]e|\blicen[cs]ed? under\b|\blicen[cs]es?:|\breleased under\b|\b(?:mit|bsd|isc|apache|l?gpl|mpl)\b", re.I)
_NAMED = re.compile(r"^(?:@version\s+v?|(?:@(?:name|module|preserve)\s+)?(?!(?:version|python|node|requires?|since|needs)\b)[^\W\d][\w.@/+-]*(?: [\w.-]+){0,4}?[ @/-]v?)\d+\.\d+(?:\.\d+)*\b", re.I)
_BLOCK = re.compile(r"/\*|<!--|[rRuU]?(?:\"\"\"|''')|\{%\s*comment\b[^%]*%\}")
_QUOTES = ('"""', "'''")
_CLOSE = {"/*": re.compile(r"\*/"), "<!--": re.compile("-->"), '"""': re.compile('"""'), "'''": re.compile("'''")}
_END = {"/*": "*/", "<!--": "-->"}
_OF_FILE = re.compile(r"@(?:generated|file|fileoverview|overview|licen[cs]e|preserve)\b|\bthis (?:file|module|code|script) (?:is|was|has been)\b", re.I)
_ORDER = re.compile(r"\b(?:do not|don't) (?:edit|modify)(?:\W*$|\W+(?:by hand|manually|this|directly)\b|[.!;])", re.I)
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|\b\d[\w.]*')
_WORD = re.compile(r"[^\W\d]\w*")
_DATA_URI = re.compile(r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]+")

#: A package marker up to this length is short.
MARKER = 200
#: A text up to this length is too short to be known as a copy.
COPY = 80
#: Text below this length is neither minified nor data.
LEAST = 400


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("notice", NOTICES), ("opening", OPENINGS), ("denial", DENIALS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _bare(line: str) -> str:
    """A comment line without its marks."""
    return line.strip().strip("#/*!<>-{}; \t").strip()


def _is_notice(line: str) -> bool:
    text = _bare(line).lower()
    raw = line.lower()
    notice = False
    for end, (kind, n) in _automaton().iter(raw):
        if kind == "denial":
            return False
        if kind == "notice":
            notice = True
        elif not notice and text.startswith(raw[end - n + 1 : end + 1]) and any(c.isdigit() for c in text):
            notice = True
    return notice


def _blocks(lines: list[str], ext: str) -> tuple[list[tuple[str, list[str]]], int]:
    """The comments before the first line of code as ``(opening, lines)``, and where they end.

    A block goes on until it is closed; line comments below one another are one block. A ``/**``
    comment right above code describes that code, not the file, unless it says otherwise.
    """
    out: list[tuple[str, list[str]]] = []
    i = 0
    while i < len(lines):
        s = lines[i].strip()
        if not s:
            i += 1
            continue
        m = _BLOCK.match(s)
        opening = m.group().lstrip("rRuU") if m and (ext in ("py", "pyi") or m.group()[-1] not in "\"'") else ""
        if not opening:
            if not _COMMENT.match(s):
                break
            start = i
            while i < len(lines) and _COMMENT.match(x := lines[i].strip()) and not _BLOCK.match(x):
                i += 1
            out.append(("", [x.strip() for x in lines[start:i]]))
            continue
        close = _CLOSE.get(opening) or re.compile(r"\{%\s*endcomment\b.*?%\}")
        block, end, at = [], None, m.end()
        for j in range(i, len(lines)):
            line = lines[j].strip()
            block.append(line)
            end = close.search(line, at)
            at = 0
            if end:
                break
        if not end:
            break
        code = block[-1][end.end() :].strip()
        after = lines[j + 1].strip() if j + 1 < len(lines) else ""
        if block[0] == "/**" and (code or after) and not (after and _COMMENT.match(after)) and not any(map(_OF_FILE.search, block)):
            break
        out.append((opening, block))
        i = j + 1
        if code and not _COMMENT.match(code):
            break
    return out, i


def _foot(lines: list[str]) -> list[str]:
    """The comment lines after the last line of code."""
    foot: list[str] = []
    for x in reversed(lines):
        s = x.strip()
        if not s:
            continue
        if not _COMMENT.match(s):
            break
        foot.append(s)
    return foot


def _is_noticed(block: tuple[str, list[str]]) -> bool:
    """Whether a comment is a notice. A docstring may speak of generated things, so there it must begin like one."""
    opening, lines = block
    if opening not in _QUOTES:
        return any(map(_is_notice, lines))
    bare = [x.strip().strip("\"'").strip() for x in lines]
    return any(_is_notice(x) and (_OF_FILE.search(x) or _automaton_start(x) or _ORDER.search(x)) for x in bare)


def _automaton_start(line: str) -> bool:
    text = _bare(line).lower()
    return text.startswith(NOTICES) or text.startswith(OPENINGS)


def _is_banner(block: list[str]) -> bool:
    """A third-party banner: in the first comment a release number and a licence.

    On one of its first two lines, or a name with its release on one and a licence on another; a
    copyright alone or the number of the licence itself isn't enough there.
    """
    for line in block[:2]:
        if _LICENCE.search(line) and _RELEASE.search(line):
            return True
    return any(_TERMS.search(x) for x in block) and any(_NAMED.search(_bare(x)) and not _TERMS.search(x) for x in block)


def _is_minified(ext: str, text: str, lines: list[str]) -> bool:
    if ext not in ("js", "mjs", "css") or len(text) < LEAST:
        return False
    code = [x for x in lines if x.strip() and not x.startswith(("//#", "/*!"))]
    if not code:
        return False
    size = sum(map(len, code))
    blanks = sum(x.count(" ") + x.count("\t") for x in code)
    return size / len(code) >= 120 and blanks / size < 0.12


def _is_data(ext: str, text: str) -> bool:
    if len(text) < LEAST or ext in ("html", "htm"):
        return False
    if ext == "css":
        return sum(map(len, _DATA_URI.findall(text))) >= 0.5 * len(text)
    rest = _LITERAL.sub("", text)
    words = sum(map(len, _WORD.findall(rest)))
    return words < 0.06 * len(text)


def fingerprint(text: str) -> int | None:
    """Of the text without its banner, line ends and outer blanks; None if it is short."""
    lines = [x.rstrip() for x in text.split("\n")]
    blocks, _ = _blocks(lines, "")
    if blocks and len(blocks[0][1]) > 1 and blocks[0][0] and _is_banner(blocks[0][1]):
        whole = next(i for i, x in enumerate(lines) if x) + len(blocks[0][1])
        lines[:whole] = [lines[whole - 1].partition(_END.get(blocks[0][0], "\0"))[2].strip()]
    while lines and (not lines[0] or (_COMMENT.match(lines[0]) and _is_banner([lines[0]]))):
        lines.pop(0)
    body = "\n".join(lines).strip()
    if len(body) < COPY:
        return None
    return xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63)


def by_path(path: str) -> str | None:
    parts = [p.lower() for p in re.split(r"[/\\]", path)]
    name, folders = parts[-1], parts[:-1]
    if any(f in VENDORED for f in folders) or any(a == "static" and b == "lib" for a, b in zip(folders, folders[1:])):
        return "vendored"
    if name in LOCKFILES:
        return "lockfile"
    if "migrations" in folders and _MIGRATION.match(name):
        return "migration"
    if _SUFFIX.search(name):
        return "suffix"
    return None


def verdict(path: str, content: str | None) -> tuple[str | None, int | None]:
    """``(reason, fingerprint)`` of a file."""
    reason = by_path(path)
    if content is None:
        return reason, None
    text = content.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    body = text.strip()
    name = re.split(r"[/\\]", path)[-1]
    if not body:
        return None, None
    if name.startswith("__init__.") and len(body) < MARKER:
        return None, None
    mark = fingerprint(text)
    if reason:
        return reason, mark
    lines = text.split("\n")
    ext = name.rsplit(".", 1)[-1].lower()
    head, end = _blocks(lines, ext)
    if any(map(_is_noticed, head)) or any(map(_is_notice, _foot(lines[end:]))):
        return "notice", mark
    if head and head[0][0] not in _QUOTES and _is_banner(head[0][1]):
        return "banner", mark
    if _is_data(ext, body):
        return "data", mark
    if _is_minified(ext, body, lines):
        return "minified", mark
    return None, mark


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [verdict(p, c if isinstance(c, str) else None) for p, c in zip(pdf["path"], pdf["content"])]
        out = pdf[["project_id", "path"]].copy()
        out["reason"] = [r for r, _ in found]
        out["mark"] = pd.array([m for _, m in found], dtype="Int64")
        yield out


def classify(files: DataFrame, content: DataFrame) -> DataFrame:
    """``(project_id, path, reason)`` of the files that weren't written by hand.

    ``content(project_id, file_path, content)`` is read once and not shuffled.
    """
    keys = files.select("project_id", "path").where(F.col("path").isNotNull()).distinct()
    texts = content.where(F.col("file_path").isNotNull()).select("project_id", F.col("file_path").alias("path"), "content")
    judged = texts.mapInPandas(_verdicts, "project_id string, path string, reason string, mark bigint")
    judged = judged.groupBy("project_id", "path").agg(F.max("reason").alias("reason"), F.max("mark").alias("mark"))
    # a file that has no content is judged by its path
    both = keys.join(judged.withColumn("_there", F.lit(True)), ["project_id", "path"], "left")
    bare = both.where(F.col("_there").isNull()).select("project_id", "path", F.lit(None).cast("string").alias("content"))
    rest = bare.mapInPandas(_verdicts, "project_id string, path string, reason string, mark bigint")
    both = both.where(F.col("_there").isNotNull()).select("project_id", "path", "reason", "mark").unionByName(rest)
    # read twice below: the verdicts are written once, the contents never pass again
    scratch = Scratch(files.sparkSession, "handwritten")
    both = scratch.keep(scratch.write(both))
    origins = both.where(F.col("reason").isin("vendored", "banner") & F.col("mark").isNotNull()).select("mark").distinct().withColumn("_copy", F.lit(True))
    out = left_join(both, origins, ["mark"], "path").withColumn("reason", F.coalesce("reason", F.when(F.col("_copy"), F.lit("copy"))))
    return out.where(F.col("reason").isNotNull()).select("project_id", "path", "reason")
