"""Scripts: functions, classes, imports, exports, calls and events.

Strings, comments and templates are blanked first (line numbers stay), then declarations and
calls are found by their tokens; owners are the nearest enclosing braces of a declaration.
"""

from __future__ import annotations

import re

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_FUNCTION = re.compile(r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)\)")
_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|([A-Za-z_$][\w$]*))\s*=>")
_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?\s*\{")
_METHOD = re.compile(r"(?:^|[{};])\s*(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*([A-Za-z_$#][\w$]*)\s*\(([^()]*)\)\s*\{")
_IMPORT = re.compile(r"^\s*import\s+(?:(.+?)\s+from\s+)?[\"']([^\"']+)[\"']", re.M | re.S)
_CALL = re.compile(r"(\bnew\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_EVENT = re.compile(r"(?:\.|\b)(\$?dispatch|emit|fire|trigger|on|once|addEventListener)\s*\(\s*[\"']([\w:.-]+)[\"']")
# Words before a bracket that are no calls, and events that listen.
_WORDS = frozenset("if for while switch catch function return typeof await super constructor with".split())
_LISTEN = frozenset(("on", "once", "addEventListener"))


def _end(text: str, at: int) -> int:
    depth = 0
    for i in range(text.find("{", at), len(text)) if "{" in text[at:] else ():
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return i
    return len(text)


def extract(path: str, text: str) -> list[dict]:
    bare = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    line = lambda i: bare.count("\n", 0, i) + 1
    out = [{"record": "node", "kind": "file", "name": path.replace("\\", "/").rsplit("/", 1)[-1], "qualified_name": path, "line": 1, "end_line": text.count("\n") + 1}]
    exported = set(re.findall(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)", bare))
    for m in re.finditer(r"\bexport\s*\{([^}]*)\}", bare):
        exported |= {x.split(" as ")[0].strip() for x in m.group(1).split(",") if x.strip()}
    exported |= set(re.findall(r"\b(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=", bare))
    spans: list[tuple[int, int, str]] = []

    def node(kind: str, name: str, q: str, a: int, b: int, owner: str, signature: str | None) -> None:
        out.append({"record": "node", "kind": kind, "name": name, "qualified_name": q, "line": line(a), "end_line": line(min(b, len(bare) - 1)) if bare else 1, "signature": signature, "exported": name in exported})
        out.append({"record": "edge", "kind": "contains", "source": owner, "qualified_name": q, "line": line(a)})
        spans.append((a, b, q))

    for m in _CLASS.finditer(bare):
        end, q = _end(bare, m.start()), f"{path}::{m.group(1)}"
        node("class", m.group(1), q, m.start(), end, path, None)
        if m.group(2):
            out.append({"record": "ref", "kind": "extends", "name": m.group(2).rsplit(".", 1)[-1], "source": q, "line": line(m.start()), "col": 0, "candidates": [m.group(2)]})
        inner = bare[m.end() - 1 : end]
        for k in _METHOD.finditer(inner):
            a = m.end() - 1 + k.start(1)
            if k.group(1) not in _WORDS or k.group(1) == "constructor":
                node("method", k.group(1), f"{q}.{k.group(1)}", a, _end(bare, a), q, f"({k.group(2).strip()})")
    for rx in (_FUNCTION, _ARROW):
        for m in rx.finditer(bare):
            args = next((g for g in m.groups()[1:] if g is not None), "")
            node("function", m.group(1), f"{path}::{m.group(1)}", m.start(), _end(bare, m.end()), path, f"({args.strip()})")
    spans.sort(key=lambda x: x[1] - x[0])

    def owner(i: int) -> str:
        return next((q for a, b, q in spans if a <= i <= b), path)

    for m in _IMPORT.finditer(text):
        names, module = m.group(1), m.group(2)
        for x in re.sub(r"[{}]", "", names or "").split(","):
            part = re.split(r"\s+as\s+", x.strip())
            if part[0]:
                out.append({"record": "ref", "kind": "imports", "name": part[0], "source": path, "line": line(m.start()), "col": 0, "candidates": [module]})
                out.append({"record": "import", "kind": "import", "name": part[-1], "signature": part[0], "module": module, "line": line(m.start())})
        if not names:
            out.append({"record": "ref", "kind": "imports", "name": module.rsplit("/", 1)[-1], "source": path, "line": line(m.start()), "col": 0, "candidates": [module]})
    declared = {a for a, _, _ in spans}
    for m in _CALL.finditer(bare):
        name = m.group(2)
        tail = name.rsplit(".", 1)[-1]
        before = bare[max(0, m.start() - 10) : m.start()]
        if tail in _WORDS or m.start(2) in declared or re.search(r"\bfunction\s*\*?\s*$|\bclass\s+$", before):
            continue
        out.append({"record": "ref", "kind": "instantiates" if m.group(1) else "calls", "name": tail, "source": owner(m.start()), "line": line(m.start()), "col": m.start() - bare.rfind("\n", 0, m.start()) - 1, "candidates": [name] if "." in name else []})
    for m in _EVENT.finditer(text):
        role = "listen" if m.group(1) in _LISTEN else "dispatch"
        out.append({"record": "event", "kind": role, "name": m.group(2), "source": owner(m.start()), "line": line(m.start()), "col": 0})
    return out
