"""Recognisers of the four languages: each raises ``ValueError`` for a text that isn't valid."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

from . import jsparse

#: Extension to language.
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "css": "css", "html": "htmldjango", "htm": "htmldjango"}

_CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|>{7}(?: .*)?|\|{7}(?: .*)?|={7})$", re.M)


def clean(text: str) -> str:
    """Without a byte order mark, with plain line ends."""
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def python(text: str) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file", "exec", dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        raise ValueError(str(e)) from None
    except (RecursionError, MemoryError):
        raise ValueError("nested too deeply") from None


def javascript(text: str) -> None:
    jsparse.check(text)


# --- CSS ---------------------------------------------------------------------------------------

_CSS_SKIP = re.compile(r"/\*.*?\*/|<!--|-->", re.S)
_CSS_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<url>url\(\s*[^"'()\s][^"'()\s]*\s*\))|(?P<str>"(?:[^"\\\n]|\\(?:.|\n))*"|'(?:[^'\\\n]|\\(?:.|\n))*')|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>;)|(?P<other>[^\s"'(){}\[\];]+)""",
    re.S,
)
_CSS_NAME = re.compile(r"^\s*(?:--[\w-]+|[*_]?-?[A-Za-z_][\w-]*)\s*:")
_CSS_SELECTOR = re.compile(r"""^(?:[\w\-.#*:>+~,\s%&|=^$@\\]|\[[^\]]*\]|\([^()]*(?:\([^()]*\)[^()]*)*\)|"[^"]*"|'[^']*'|[^\x00-\x7f])+$""")
_CSS_AT = re.compile(r"^\s*@-?[A-Za-z][\w-]*")


def css(text: str) -> None:
    bare = _CSS_SKIP.sub(" ", text)
    if "/*" in re.sub(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|url\([^)]*\)', "", bare):
        raise ValueError("open comment")
    if _CONFLICT.search(bare):
        raise ValueError("merge leftovers")
    stack: list[str] = []
    piece: list[str] = []  # text since the last ; { or } of this level
    i = 0

    def declaration(s: str) -> None:
        s = s.strip()
        if not s:
            return
        if _CSS_AT.match(s):
            return
        m = _CSS_NAME.match(s)
        if not m or not s[m.end() :].strip():
            raise ValueError(f"not a declaration: {s[:30]!r}")
        if not stack:
            raise ValueError("declaration outside a block")

    while i < len(bare):
        m = _CSS_TOKEN.match(bare, i)
        if not m:
            raise ValueError("open string")
        i = m.end()
        kind = m.lastgroup
        if kind == "other" or kind == "space":
            piece.append(m.group())
            continue
        v = m.group()
        if kind == "open" and v == "{":
            head = "".join(piece).strip()
            if any(c in "([" for c in stack):
                raise ValueError("block inside brackets")
            if not head or not (_CSS_AT.match(head) or _CSS_SELECTOR.match(head)):
                raise ValueError(f"not a selector: {head[:30]!r}")
            if not _CSS_AT.match(head) and re.search(r"\b(?:function|class|const|let|var|return)\s+\w", head):
                raise ValueError("code")
            stack.append(v)
            piece = []
        elif kind == "open":
            stack.append(v)
            piece.append(v)
        elif kind == "close":
            if not stack or {"(": ")", "[": "]", "{": "}"}[stack[-1]] != v:
                raise ValueError(f"unexpected {v}")
            if v == "}":
                declaration("".join(piece))
                piece = []
            else:
                piece.append(v)
            stack.pop()
        elif kind == "end" and not any(c in "([" for c in stack):
            declaration("".join(piece))
            piece = []
        else:
            piece.append(v)
    if stack:
        raise ValueError("open block")
    rest = "".join(piece).strip()
    if rest and not (_CSS_AT.match(rest) and not rest.startswith("@media")):
        raise ValueError("rule without a block")


# --- Django templates ----------------------------------------------------------------------------

_TAG = re.compile(r"\{%(.*?)%\}|\{\{(.*?)\}\}|\{#(.*?)#\}", re.S)
# The block tags of Django and what may stand between their ends.
BLOCKS = {
    "if": ("elif", "else"),
    "for": ("empty",),
    "block": (),
    "with": (),
    "autoescape": (),
    "filter": (),
    "spaceless": (),
    "ifchanged": ("else",),
    "blocktrans": ("plural",),
    "blocktranslate": ("plural",),
    "cache": (),
    "localize": (),
    "localtime": (),
    "timezone": (),
    "language": (),
    "partialdef": (),
}
# Elements without content, and those whose end may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL = frozenset("html head body p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption rp rt".split())
_QUOTED = re.compile(r'"[^"]*"|\'[^\']*\'')
_ELEMENT = re.compile(r"""<(/?)([A-Za-z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
_RAW = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)


def htmldjango(text: str) -> bool:
    """Whether there is a tag or element at all: nearly any text is a template."""
    stack: list[str] = []
    out: list[str] = []
    i = 0
    later = set(re.findall(r"\{%-?\s*end(\w+)", text))
    while True:
        j = min((k for k in (text.find(x, i) for x in ("{%", "{{", "{#")) if k >= 0), default=-1)
        if j < 0:
            out.append(text[i:])
            break
        out.append(text[i:j])
        close = {"{%": "%}", "{{": "}}", "{#": "#}"}[text[j : j + 2]]
        end = text.find(close, j + 2)
        line = text.find("\n", j)
        if end < 0 or (0 <= line < end and close != "%}"):
            raise ValueError(f"open {text[j : j + 2]}")
        inner = text[j + 2 : end]
        i = end + 2
        if close == "#}":
            continue
        if "{%" in inner or "{{" in inner:
            raise ValueError("tag in a tag")
        body = inner.strip()
        if not body:
            raise ValueError("empty tag")
        if any(q in _QUOTED.sub("", body) for q in '"') and "'" not in body:
            raise ValueError("open string in a tag")
        out.append("\x00")
        if close == "}}":
            if body[0] in "|.:" or body[-1] in "|.:":
                raise ValueError("bad variable")
            continue
        word, _, rest = body.partition(" ")
        word = word.split("\n")[0].strip()
        if word in ("comment", "verbatim"):
            m = re.compile(r"\{%\s*end" + word + r"\b[^%]*%\}").search(text, i)
            if not m:
                raise ValueError(f"open {word}")
            i = m.end()
            continue
        if word.startswith("end") and len(word) > 3:
            name = word[3:]
            if not stack or stack[-1] != name:
                raise ValueError(f"unexpected {word}")
            stack.pop()
        elif word in BLOCKS or word in later:
            if word in ("if", "for", "block", "with", "filter") and not rest.strip():
                raise ValueError(f"{word} without arguments")
            if word == "for" and not re.match(r".+\sin\s.+", rest.strip(), re.S):
                raise ValueError("bad for")
            if word == "language" and word not in later:
                continue
            stack.append(word)
        else:
            for b, parts in BLOCKS.items():
                if word in parts:
                    if not stack or (word not in BLOCKS.get(stack[-1], ()) and stack[-1] in BLOCKS):
                        raise ValueError(f"unexpected {word}")
                    break
            else:
                if not re.match(r"^[\w.:-]+$", word):
                    raise ValueError("bad tag")
    if stack:
        raise ValueError(f"open {stack[-1]}")
    html = "".join(out)
    while True:
        a = html.find("<!--")
        if a < 0:
            break
        b = html.find("-->", a + 4)
        if b < 0:
            raise ValueError("open comment")
        html = html[:a] + html[b + 3 :]
    if _CONFLICT.search(html):
        raise ValueError("merge leftovers")
    html = _RAW.sub("", html)
    if re.search(r"<(?:script|style)\b", html, re.I):
        raise ValueError("open script")
    rest = _ELEMENT.sub("", html)
    if re.search(r"<[A-Za-z/!][^<>]*$", rest):
        raise ValueError("open element")
    depth: dict[str, int] = {}
    for m in _ELEMENT.finditer(html):
        name = m.group(2).lower()
        if name in VOID or name in OPTIONAL or m.group(3).rstrip().endswith("/"):
            continue
        depth[name] = depth.get(name, 0) + (-1 if m.group(1) else 1)
    if any(n > 0 for n in depth.values()) and "\x00" not in html:
        raise ValueError("open element")
    return "\x00" in html or bool(_ELEMENT.search(html)) or not html.strip()


PARSERS = {"python": python, "javascript": javascript, "css": css, "htmldjango": htmldjango}


# Tokens that tell a language, each found at the weight of one.
_SIGNS = {
    "python": re.compile(r"^[ \t]*(?:def|class|elif|except|with|async def)\b.*:\s*$|^(?:from [\w.]+ )?import [\w., ]+$|\bself\b|\bNone\b|\"\"\"", re.M),
    "javascript": re.compile(r"\b(?:function|const|let|var)\b|=>|===|\bnull\b|;[ \t]*$|\bdocument\.|\bexport\b", re.M),
    "css": re.compile(r"^[ \t]*(?:[.#@]?[\w-][ ,.#:>\w-]*\{|[\w-]+:[ \t]*[^;{}\n]+;)", re.M),
    "htmldjango": re.compile(r"\{%|\{\{|</?[a-z][\w-]*[ >]"),
}


_PLAIN = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_LITERALS = {
    "python": re.compile(r'""".*?"""|\'\'\'.*?\'\'\'|' + _PLAIN + r"|#[^\n]*", re.S),
    "javascript": re.compile(r"/\*.*?\*/|//[^\n]*|`(?:[^`\\]|\\.)*`|" + _PLAIN, re.S),
    "css": re.compile(r"/\*.*?\*/|" + _PLAIN, re.S),
}


_LINE_SIGN = re.compile(r"(?:def|class|elif|except|with|async def)\b.*:\s*$")
_IMPORT_SIGN = re.compile(r"(?:from [\w.]+ )?import [\w., ]+$")
_STATEMENTS = ("def", "class", "elif", "except", "with", "async def", "from ", "import ")
_JS_END = re.compile(r";[ \t]*$", re.M)


def _words(text: str, *words: str) -> int:
    """How often words stand alone; a literal search finds the places."""
    n = 0
    for w in words:
        at = text.find(w)
        while at >= 0:
            end = at + len(w)
            n += not ((at and (text[at - 1].isalnum() or text[at - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_")))
            at = text.find(w, end)
    return n


def _signs(language: str, text: str) -> int:
    """The number of a language's telling tokens, as ``_SIGNS`` has them, by literal searches first."""
    if language == "python":
        n = text.count('"""') + _words(text, "self", "None")
        for line in text.split("\n"):
            bare = line.lstrip(" \t")
            if bare.startswith(_STATEMENTS):
                n += bool(_LINE_SIGN.match(bare) or len(bare) == len(line) and _IMPORT_SIGN.match(bare))
        return n
    if language == "javascript":
        n = text.count("=>") + text.count("===") + _words(text, "function", "const", "let", "var", "null", "export")
        return n + (len(_JS_END.findall(text)) if ";" in text else 0) + (len(re.findall(r"\bdocument\.", text)) if "document." in text else 0)
    needed = ("{", ";") if language == "css" else ("{%", "{{", "<")
    return len(_SIGNS[language].findall(text)) if any(x in text for x in needed) else 0


def rank(text: str, languages: Iterable[str] = tuple(_SIGNS)) -> list[str]:
    """The languages by how many of their telling tokens the text has."""
    n = {k: _signs(k, text) for k in languages}
    return sorted(n, key=lambda k: (-n[k], k))


def _verdicts(text: str) -> tuple[dict[str, str | None], bool]:
    """Of every grammar, from the likeliest language to the least, its error or None; and whether
    the text has any mark of a template."""
    out: dict[str, str | None] = {}
    marks = True
    for language in rank(text):
        try:
            said = PARSERS[language](text)
            out[language] = None
            marks = said if language == "htmldjango" else marks
        except ValueError as e:
            out[language] = str(e)[:200] or "invalid"
    return out, marks


def _foreign(text: str, accepted: list[str], marks: bool) -> str | None:
    """The language of a text that the template grammar accepts, as it does nearly any.

    Another grammar that accepts it as a whole holds if there is no mark of a template, or if the
    text has more of its telling tokens than of templates' outside of strings and comments.
    """
    for language in accepted:
        if language == "htmldjango":
            continue
        signs = len(_SIGNS[language].findall(text))
        if not marks or (signs and signs > len(_SIGNS["htmldjango"].findall(_LITERALS[language].sub(" ", text)))):
            return language
    return None


def diagnose(language: str, text: str | None) -> tuple[str | None, str | None]:
    """``(error, actual)``: None if valid; ``actual`` is the language that the text is valid in.

    The text is parsed by all grammars, from the likeliest language on. That of its extension must
    accept it; where it doesn't, the first other that does names the language.
    """
    if text is None:
        return None, None
    text = clean(text)
    if not text.strip():
        return None, None
    verdicts, marks = _verdicts(text)
    accepted = [k for k, error in verdicts.items() if error is None]
    error = verdicts[language]
    if error is None:
        actual = _foreign(text, accepted, marks) if language == "htmldjango" else None
        return (f"text in {actual}", actual) if actual else (None, None)
    others = [k for k in accepted if k != "htmldjango" or (_SIGNS[k].search(text) and not _foreign(text, accepted, marks))]
    return error, others[0] if others else None
