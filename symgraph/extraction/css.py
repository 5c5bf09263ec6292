"""Style sheets: class and id selectors, each once per file."""

from __future__ import annotations

import re

_SKIP = re.compile(r"/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_NAME = re.compile(r"([.#])(-?[A-Za-z_][\w-]*)")


def extract(path: str, text: str) -> list[dict]:
    bare = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out = [{"record": "node", "kind": "file", "name": path.replace("\\", "/").rsplit("/", 1)[-1], "qualified_name": path, "line": 1, "end_line": text.count("\n") + 1}]
    seen: set[str] = set()
    for m in re.finditer(r"([^{}]*)\{", bare):
        head = m.group(1)
        if head.strip().startswith("@"):
            continue
        for n in _NAME.finditer(head):
            label = n.group()
            if label not in seen:
                seen.add(label)
                line = bare.count("\n", 0, m.start(1) + n.start()) + 1
                out.append({"record": "node", "kind": "selector", "name": n.group(2), "qualified_name": f"{path}::{label}", "line": line, "end_line": line, "signature": label})
                out.append({"record": "edge", "kind": "contains", "source": path, "qualified_name": f"{path}::{label}", "line": line})
    return out
