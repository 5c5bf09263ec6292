"""Django templates: the template itself, what it extends, includes and links to, the tags and
variables it uses, its styles and its Alpine attributes."""

from __future__ import annotations

import re

_TAG = re.compile(r"\{%-?\s*(\w+)\s*(.*?)-?%\}|\{\{\s*(.*?)\s*\}\}|\{#.*?#\}", re.S)
_STRING = re.compile(r"^[\"']([^\"']+)[\"']")
_ATTRIBUTE = re.compile(r"\s(class|id|x-[\w:.-]+|@[\w:.-]+|src|href)\s*=\s*\"([^\"]*)\"")
# The tags that every template has.
BUILTIN = frozenset(
    """autoescape endautoescape block endblock comment endcomment csrf_token cycle debug extends filter endfilter firstof for empty endfor if elif else endif
    ifchanged endifchanged include load lorem now regroup resetcycle spaceless endspaceless templatetag url verbatim endverbatim widthratio with endwith static
    get_static_prefix get_media_prefix trans translate blocktrans endblocktrans blocktranslate endblocktranslate plural language endlanguage cache endcache""".split()
)
# The filters that every template has, with those of the framework's humanize library.
_BUILTIN_FILTERS = frozenset(
    """add addslashes apnumber capfirst center cut date default default_if_none dictsort dictsortreversed divisibleby escape escapejs filesizeformat first floatformat
    force_escape get_digit intcomma intword iriencode join json_script last length length_is linebreaks linebreaksbr linenumbers ljust lower make_list naturalday naturaltime ordinal phone2numeric pluralize pprint random
    rjust safe safeseq slice slugify stringformat striptags time timesince timeuntil title truncatechars truncatewords unordered_list upper urlencode urlize
    wordcount wordwrap yesno""".split()
)


def template_name(path: str) -> str:
    p = path.replace("\\", "/")
    return p.rsplit("templates/", 1)[-1] if "templates/" in p else p.rsplit("/", 1)[-1]


def extract(path: str, text: str) -> list[dict]:
    name = template_name(path)
    line = lambda i: text.count("\n", 0, i) + 1
    out: list[dict] = [{"record": "node", "kind": "template", "name": name, "qualified_name": path, "line": 1, "end_line": text.count("\n") + 1}]

    def ref(kind: str, to: str, at: int, candidates: list[str] | None = None) -> None:
        out.append({"record": "ref", "kind": kind, "name": to, "source": path, "line": line(at), "col": at - text.rfind("\n", 0, at) - 1, "candidates": candidates or []})

    skip = 0
    for m in _TAG.finditer(text):
        if m.start() < skip:
            continue
        tag, rest, variable = m.group(1), (m.group(2) or "").strip(), m.group(3)
        if tag in ("comment", "verbatim"):
            end = re.compile(r"\{%\s*end" + tag).search(text, m.end())
            skip = end.start() if end else len(text)
            continue
        literal = _STRING.match(rest)
        if tag == "extends" and literal:
            ref("extends_template", literal.group(1), m.start())
        elif tag == "include" and literal:
            ref("includes_template", literal.group(1), m.start())
        elif tag == "url" and literal:
            ref("resolves", literal.group(1), m.start())
        elif tag == "static" and literal:
            ref("references", literal.group(1), m.start())
        elif tag == "for":
            loop = re.fullmatch(r"(\w+)\s+in\s+([\w.]+?)(?:\.all)?(?:\s+reversed)?", rest)
            if loop:
                ref("loop_binding", loop.group(1), m.start(), [loop.group(2)])
        elif tag and tag not in BUILTIN and not tag.startswith("end"):
            ref("uses_tag", tag, m.start())
        shown = variable if variable is not None else rest if tag in ("if", "elif", "with", "for") else ""
        for f in re.findall(r"\|(\w+)", shown or ""):
            if f not in _BUILTIN_FILTERS:
                ref("uses_tag", f, m.start())
        member = re.match(r"(?:not\s+)?([a-z_]\w*)\.([a-zA-Z_]\w*)", shown or "")
        if member and member.group(1) not in ("forloop", "block", "request"):
            ref("accesses_member", member.group(2), m.start(), [member.group(1)])
    bare = _TAG.sub(lambda m: " " * len(m.group()), text)
    for m in _ATTRIBUTE.finditer(bare):
        key, value = m.group(1), m.group(2)
        if key == "class":
            for c in value.split():
                ref("styles", c, m.start(), ["." + c])
        elif key == "id" and value.strip():
            ref("styles", value.strip(), m.start(), ["#" + value.strip()])
        elif key.startswith(("@", "x-on:")):
            for f in re.findall(r"([A-Za-z_$][\w$]*)\s*\(", value):
                ref("handles", f, m.start())
            out.append({"record": "event", "kind": "listen", "name": re.sub(r"^(?:@|x-on:)|\..*$", "", key), "source": path, "line": line(m.start()), "col": 0})
        elif key == "x-data":
            for f in re.findall(r"([A-Za-z_$][\w$]*)\s*\(", value):
                ref("handles", f, m.start())
        elif key in ("src", "href") and value and not value.startswith(("http", "#", "/", "mailto:")):
            ref("references", value, m.start())
    return out
