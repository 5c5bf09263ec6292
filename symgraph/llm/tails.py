"""Reading the end of a text: marks of a cut, tokens of its last line, and what is left open."""

from __future__ import annotations

import re

from . import jsparse
from .grammars import rank

# What a cut may leave behind a text, besides blanks and dots.
_SIGNS = "…�\x00"
_NOTE = re.compile(r"(?:\((?:more|truncated|cut|snip|cont(?:inued|\.)?|\.\.\.)\)|\[(?:…|\.\.\.|more|truncated|cut|snip(?:ped)?)\]|<(?:cut|snip|truncated|more)>)$", re.I)
# letters of other scripts stand beside numbers without a blank, so only Latin ones join a run
_TOKEN = re.compile(r"(\s*)(?:([A-Za-z]*\d[A-Za-z\d]*)|([^\W\d_]+|[^\w\s]|\w))", re.UNICODE)


def body(text: str) -> str:
    """The text without blanks and marks of a cut at its end (read from the end only)."""
    while True:
        t = text.rstrip().rstrip(_SIGNS)
        if t.endswith("..."):
            t = t.rstrip(".")
        elif m := _NOTE.search(t[-16:]):
            t = t[: len(t) - len(m.group())]
        if t == text:
            return t
        text = t


def tokens(line: str) -> list[tuple[str, bool]]:
    """``(token, blank before)`` of a line: words, runs with digits as ``0``, single signs."""
    return [("0" if run else t, gap != "") for gap, run, t in _TOKEN.findall(line)]


def lines(text: str) -> list[str]:
    return [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]


_CODE = re.compile(
    r"^\s*(?:def |class |async |import |from \S+ import|return\b|if .*[:{(]$|for .*[:{]$|while |try[:{ ]|except|else[:{ ]|elif |const |let |var |function\b|export |[})\]]+[;,]?$|@\w|[\w.\[\]]+ = |[\w.]+\(.*\);?$|\"\"\")"
)


_REMARK = re.compile(r"^\s*(?://|/\*|#)|^\s+\*")


def looks_like_code(rows: list[str]) -> bool:
    """At least half of the lines are code or remarks, and some are code."""
    code = sum(bool(_CODE.match(x)) for x in rows)
    return len(rows) >= 2 and code > 0 and code + sum(bool(_REMARK.match(x)) for x in rows) >= 0.5 * len(rows)


def left_open(text: str, rows: list[str] | None = None, code: bool | None = None) -> str | None:
    """What is open at the end of the body: a fence, bracket, quote, string, block or statement.

    ``rows`` and ``code``: the lines of the body that ``text`` then is, and whether they are code.
    """
    if rows is None:
        text = body(text)
        rows = lines(text)
    if not rows:
        return None
    code = looks_like_code(rows) if code is None else code
    if sum(x.lstrip().startswith("```") for x in rows) % 2:
        return "fence"
    if code:
        return _open_code(text, rows)
    last = rows[-1]
    if last.count("`") % 2 and "```" not in last:
        return "quote"
    depth = 0
    for m in re.finditer(r"[(\[]|(?<![:;=])[)\]]", last):
        depth = depth + 1 if m.group() in "([" else max(0, depth - 1)
    if depth and re.search(r"[(\[][^()\[\]]*$", last):
        return "bracket"
    if last.rstrip()[-1:] in ("(", "[", "{", ","):
        return "bracket"
    return None


def _open_code(text: str, rows: list[str]) -> str | None:
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    kinds = rank(text, ("python", "javascript"))
    if kinds[0] == "python":
        import warnings

        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "text", "exec", dont_inherit=True)
            return None
        except SyntaxError as e:
            said = str(e.msg)
            at = e.lineno or 0
            total = len(text.rstrip().split("\n"))
            if "never closed" in said or "unterminated triple" in said or "EOF" in said or at >= total:
                return "statement"
            return None
        except (ValueError, RecursionError, MemoryError):
            return None
    parser = None
    try:
        parser = jsparse.Parser(text)
        parser.program()
        return None
    except (jsparse.JsError, RecursionError) as e:
        # left open only if the trouble is at the very end
        at = parser.at if parser is not None else 0
        if str(e).startswith("open") or parser is None or parser.k == "eof" or at >= len(text.rstrip()) - 1 or "\n" not in text[at:].strip():
            return "statement"
        return None
