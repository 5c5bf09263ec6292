"""Python source: classes, functions, fields, routes, and what they refer to (by ``ast``)."""

from __future__ import annotations

import ast
import re

MARK = "\x01"
# Field constructors of models are recognised by these endings, relations by name.
_FIELD = re.compile(r"(?:Field|ForeignKey|Relation)$")
_RELATION = ("ForeignKey", "OneToOneField", "ManyToManyField", "GenericRelation")
_TEST = re.compile(r"(?:TestCase|Tests?)$")
_LAYER = re.compile(r"(?:View|Form|Model|Service|Serializer|Admin|Manager)$")
# Attributes of class-based views that name a model or a form.
_VIEW_ATTRIBUTES = ("model", "form_class", "serializer_class", "queryset_class", "filterset_class")
# Shortcuts that answer with a model, ends of a queryset's chain that answer with one
# instance, and those that answer with a collection.
_SHORTCUTS = ("get_object_or_404", "get_list_or_404")
_SINGLE = ("get", "first", "last", "latest", "earliest", "create", "get_or_create", "update_or_create")
_COLLECTIONS = ("all", "filter", "exclude", "order_by", "select_related", "prefetch_related", "annotate", "distinct", "none", "reverse")


def dotted(e: ast.AST) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        head = dotted(e.value)
        return f"{head}.{e.attr}" if head else None
    if isinstance(e, ast.Call):
        return dotted(e.func)
    return None


def text_of(e: ast.AST | None) -> str | None:
    return e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str) -> None:
        self.path = path
        self.out: list[dict] = []
        self.owner: list[str] = [path]
        self.classes: list[ast.ClassDef] = []
        self.names: dict[str, str] = {}  # definitions of this file by name
        self.twice: set[str] = set()
        self.types: list[dict[str, str]] = [{}]
        self.exported: set[str] = set()
        self.test = bool(re.search(r"(^|[/\\])tests?[/\\]|(^|[/\\])(test_|conftest)[^/\\]*$|_test\.py$", path, re.I))
        self.urls = bool(re.search(r"(^|[/\\])urls(\.py|[/\\])", path))
        self.counts: dict[str, int] = {}

    # -- records
    @property
    def here(self) -> str:
        return self.owner[-1]

    def node(self, kind: str, name: str, at: ast.AST, **more: object) -> str:
        base = f"{self.path}::{name}" if self.here == self.path else f"{self.here}.{name}"
        self.out.append({"record": "node", "kind": kind, "name": name, "qualified_name": base, "line": at.lineno, "end_line": at.end_lineno, "col": at.col_offset, "exported": name in self.exported, **more})
        self.out.append({"record": "edge", "kind": "contains", "source": self.here, "qualified_name": base, "line": at.lineno, "col": at.col_offset})
        if self.here == self.path:
            if name in self.names:
                self.twice.add(name)
            self.names[name] = base
        return base

    def ref(self, kind: str, name: str | None, at: ast.AST, candidates: list[str] | None = None, source: str | None = None) -> None:
        if name:
            self.out.append({"record": "ref", "kind": kind, "name": name, "source": source or self.here, "line": at.lineno, "col": at.col_offset, "candidates": candidates or []})

    # -- module
    def visit_Module(self, m: ast.Module) -> None:
        end = max([1, *(getattr(x, "end_lineno", 1) or 1 for x in m.body)])
        self.out.append({"record": "node", "kind": "file", "name": self.path.replace("\\", "/").rsplit("/", 1)[-1], "qualified_name": self.path, "line": 1, "end_line": end, "docstring": ast.get_docstring(m, False)})
        for x in m.body:
            if isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, ast.List | ast.Tuple):
                self.exported |= {v for v in map(text_of, x.value.elts) if v}
        self.generic_visit(m)

    def visit_Import(self, s: ast.Import) -> None:
        for a in s.names:
            self.ref("imports", a.name, s, [a.name])
            self.out.append({"record": "import", "kind": "import", "name": a.asname or a.name.split(".")[0], "signature": "", "module": a.name, "line": s.lineno})

    def visit_ImportFrom(self, s: ast.ImportFrom) -> None:
        module = "." * s.level + (s.module or "")
        for a in s.names:
            self.ref("imports", a.name, s, [module])
            self.out.append({"record": "import", "kind": "import", "name": a.asname or a.name, "signature": a.name, "module": module, "line": s.lineno})

    # -- classes
    def visit_ClassDef(self, c: ast.ClassDef) -> None:
        bases = [b for b in (dotted(x) for x in c.bases) if b]
        tails = [b.rsplit(".", 1)[-1] for b in bases]
        fields = [x for x in c.body if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and _FIELD.search((dotted(x.value) or "").rsplit(".", 1)[-1])]
        if any(t.endswith("Model") and t != "BaseModel" for t in tails):
            kind = "model"
        elif any(t.endswith(("View", "ViewSet", "APIView")) for t in tails):
            kind = "view"
        else:
            kind = "model" if fields else "class"
        signature = f"({', '.join(bases)})" if bases else None
        q = self.node(kind, c.name, c, signature=signature, docstring=ast.get_docstring(c, False), decorators=[ast.unparse(d) for d in c.decorator_list])
        for b in bases:
            self.ref("extends", b.rsplit(".", 1)[-1], c, [b], q)
        self.decorated(c, q)
        if self.test and _TEST.search(c.name):
            subject = _TEST.sub("", c.name)
            self.ref("tests", subject, c, [subject, _LAYER.sub("", subject)], q)
        self.owner.append(q)
        self.classes.append(c)
        for x in c.body:
            if isinstance(x, ast.Assign | ast.AnnAssign):
                self.attribute(x, kind, q)
            else:
                self.visit(x)
        self.classes.pop()
        self.owner.pop()

    def attribute(self, x: ast.Assign | ast.AnnAssign, kind: str, q: str) -> None:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target]
        names = [t.id for t in targets if isinstance(t, ast.Name)]
        call = x.value if isinstance(x.value, ast.Call) else None
        maker = (dotted(call) or "").rsplit(".", 1)[-1] if call else ""
        for name in names:
            if call and _FIELD.search(maker):
                help_text = next((text_of(k.value) for k in call.keywords if k.arg == "help_text"), None)
                shown = ", ".join([*map(ast.unparse, call.args), *(f"{k.arg}={ast.unparse(k.value)}" for k in call.keywords if k.arg != "help_text")])
                field = self.node("field", name, x, signature=f"{maker}({shown})" + (f" {help_text}" if help_text else ""))
                if maker in _RELATION and call.args:
                    target = text_of(call.args[0]) or dotted(call.args[0])
                    if target == "self":
                        target = q.rsplit("::", 1)[-1].rsplit(".", 1)[-1]
                    if target:
                        tail = target.rsplit(".", 1)[-1]
                        self.ref("relates_to", tail, x, [target], q)
                        back = next((text_of(k.value) for k in call.keywords if k.arg == "related_name"), None)
                        self.ref("reverse_accessor", tail, x, [back or f"{q.rsplit('.', 1)[-1].rsplit('::', 1)[-1].lower()}_set"], field)
            elif kind == "view" and name in _VIEW_ATTRIBUTES:
                self.ref("relates_to", (dotted(x.value) or "").rsplit(".", 1)[-1] if x.value else None, x, None, q)
            elif kind == "view" and name == "template_name":
                self.ref("renders", text_of(x.value), x, None, q)
            else:
                self.node("constant" if name.isupper() else "variable", name, x)
        if isinstance(x, ast.AnnAssign):
            self.annotation(x.annotation, "type_of", q)
        if x.value is not None:
            self.visit(x.value)

    # -- functions
    def visit_FunctionDef(self, f: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        tails = [(dotted(d) or "").rsplit(".", 1)[-1] for d in f.decorator_list]
        first = f.args.args[0].arg if f.args.args else ""
        if any(t in ("property", "cached_property") for t in tails):
            kind = "property"
        elif self.classes and self.here != self.path:
            kind = "method"
        elif first == "request" and self.here == self.path and "fixture" not in tails:
            kind = "view"
        else:
            kind = "function"
        returns = f" -> {ast.unparse(f.returns)}" if f.returns else ""
        q = self.node(kind, f.name, f, signature=f"({ast.unparse(f.args)}){returns}", docstring=ast.get_docstring(f, False), decorators=[ast.unparse(d) for d in f.decorator_list])
        self.decorated(f, q)
        scope: dict[str, str] = {}
        for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]:
            if a.annotation is not None:
                self.annotation(a.annotation, "type_of", q)
                t = dotted(a.annotation) or text_of(a.annotation)
                if t:
                    scope[a.arg] = t.rsplit(".", 1)[-1]
        if f.returns is not None:
            self.annotation(f.returns, "returns", q)
        for x in ast.walk(f):
            if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name) and isinstance(x.value, ast.Call):
                made = (dotted(x.value) or "").rsplit(".", 1)[-1]
                if made[:1].isupper():
                    scope.setdefault(x.targets[0].id, made)
                elif made:
                    scope.setdefault(x.targets[0].id, f"{MARK}returns-of:{made}")
        self.owner.append(q)
        self.types.append(scope)
        for x in f.body:
            self.visit(x)
        self.types.pop()
        self.owner.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def decorated(self, x: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, q: str) -> None:
        for d in x.decorator_list:
            name = dotted(d)
            if not name:
                continue
            tail = name.rsplit(".", 1)[-1]
            self.ref("decorates", tail, d, [name], q)
            if isinstance(d, ast.Call):
                if tail == "receiver":
                    for k in d.keywords:
                        if k.arg == "sender":
                            self.ref("receives", (dotted(k.value) or "").rsplit(".", 1)[-1], d, None, q)
                elif name == "admin.register":
                    for a in d.args:
                        self.ref("admin_of", (dotted(a) or "").rsplit(".", 1)[-1], d, None, q)
                self.visit(d)

    def annotation(self, e: ast.AST, kind: str, q: str) -> None:
        for x in ast.walk(e):
            if isinstance(x, ast.Name) and x.id[:1].isupper():
                self.ref(kind, x.id, x, None, q)
            elif isinstance(x, ast.Constant) and isinstance(x.value, str) and re.fullmatch(r"[A-Z]\w*", x.value):
                self.ref(kind, x.value, x, None, q)

    # -- bindings and expressions
    def context(self, s: ast.Assign) -> None:
        """What a function binds a local to: an instance or a collection of a model, or what an
        accessor of another local holds."""
        if len(s.targets) != 1 or not isinstance(s.targets[0], ast.Name) or not isinstance(s.value, ast.Call):
            return
        local, call = s.targets[0].id, s.value
        maker = (dotted(call.func) or "").rsplit(".", 1)[-1]
        if maker in _SHORTCUTS and call.args and not isinstance(call.func, ast.Call):
            model = (dotted(call.args[0]) or "").rsplit(".", 1)[-1]
            if model[:1].isupper():
                self.ref("context_type", model, s, [local, *([MARK + "collection"] if maker == "get_list_or_404" else [])])
                return
        chain: list[str] = []
        base: ast.AST = call
        while isinstance(base, ast.Call) and isinstance(base.func, ast.Attribute):
            chain.append(base.func.attr)
            base = base.func.value
        if not chain or not isinstance(base, ast.Attribute):
            return
        single = chain[0] in _SINGLE
        if base.attr == "objects":
            model = (dotted(base.value) or "").rsplit(".", 1)[-1]
            if model[:1].isupper():
                self.ref("context_type", model, s, [local, *([] if single else [MARK + "collection"])])
        elif isinstance(base.value, ast.Name) and base.value.id not in ("self", "cls") and not base.value.id[:1].isupper() and chain[0] in _COLLECTIONS:
            self.ref("derived_collection", base.attr, s, [local, base.value.id])

    def visit_Assign(self, s: ast.Assign) -> None:
        if len(self.types) > 1:  # in a function
            self.context(s)
        if self.here == self.path:
            for t in s.targets:
                if isinstance(t, ast.Name) and t.id != "__all__":
                    words = [w for w in map(text_of, s.value.elts) if w] if isinstance(s.value, ast.List | ast.Tuple) else []
                    shown = ", ".join(words) if words and len(", ".join(words).encode()) <= 600 else None
                    self.node("constant" if re.fullmatch(r"_?[A-Z][A-Z0-9_]*", t.id) else "variable", t.id, s, signature=shown)
        self.visit(s.value)

    def visit_AnnAssign(self, s: ast.AnnAssign) -> None:
        if self.here == self.path and isinstance(s.target, ast.Name):
            self.node("constant" if s.target.id.isupper() else "variable", s.target.id, s)
            self.annotation(s.annotation, "type_of", self.here)
        if s.value is not None:
            self.visit(s.value)

    def visit_Attribute(self, a: ast.Attribute) -> None:
        if isinstance(a.value, ast.Name) and a.value.id == "settings" and a.attr[:1].isupper():
            self.ref("reads", a.attr, a)
        self.generic_visit(a)

    def visit_Call(self, c: ast.Call) -> None:
        name = dotted(c.func)
        if name:
            self.call(c, name)
        for x in [*c.args, *(k.value for k in c.keywords)]:
            if isinstance(x, ast.Name) and x.id in self.names and x.id not in self.twice:
                self.out.append({"record": "edge", "kind": "references", "source": self.here, "qualified_name": self.names[x.id], "line": x.lineno, "col": x.col_offset})
        self.generic_visit(c)

    def call(self, c: ast.Call, name: str) -> None:
        head, _, tail = name.rpartition(".")
        arg = text_of(c.args[0]) if c.args else None
        if tail in ("reverse", "reverse_lazy", "redirect") and arg:
            self.ref("resolves", arg, c)
        if tail in ("render", "render_to_string", "get_template") or tail == "TemplateResponse":
            shown = next((text_of(x) for x in c.args[:2] if text_of(x)), None)
            self.ref("renders", shown, c)
        for k in c.keywords:
            if k.arg in ("template", "template_name"):
                self.ref("renders", text_of(k.value), c)
        if name == "admin.site.register" and c.args:
            self.ref("admin_of", (dotted(c.args[0]) or "").rsplit(".", 1)[-1], c)
        if tail == "connect" and any(k.arg == "sender" for k in c.keywords):
            sender = next(k.value for k in c.keywords if k.arg == "sender")
            self.ref("receives", (dotted(sender) or "").rsplit(".", 1)[-1], c)
        if self.urls and tail in ("path", "re_path", "url") and arg is not None and len(c.args) > 1:
            self.route(c, arg)
            return
        candidates: list[str] = []
        if isinstance(c.func, ast.Attribute):
            root = c.func.value
            if isinstance(root, ast.Call) and dotted(root) == "super":
                candidates = [MARK + "super-dispatch"]
            elif head in ("self", "cls") and self.classes:
                owner = self.here.rsplit(".", 1)[0]
                candidates = [owner]
            elif head.endswith(".objects") or ".objects." in f"{head}.":
                candidates = [MARK + "queryset-dispatch", head.split(".objects")[0].rsplit(".", 1)[-1]]
            elif head.endswith(("services", "service")):
                candidates = [MARK + "service-dispatch", head.rsplit(".", 1)[0].rsplit(".", 1)[-1]]
            elif head in self.types[-1]:
                known = self.types[-1][head]
                candidates = [known] if known.startswith(MARK) else [MARK + "typed-receiver", known]
            elif head:
                candidates = [MARK + "receiver-root", head.split(".")[0]]
        self.ref("instantiates" if tail[:1].isupper() else "calls", tail or name, c, candidates)

    def route(self, c: ast.Call, pattern: str) -> None:
        label = next((text_of(k.value) for k in c.keywords if k.arg == "name"), None)
        n = self.counts[pattern] = self.counts.get(pattern, 0) + 1
        q = f"{self.path}::route::{pattern}" + (f"#{n}" if n > 1 else "")
        self.out.append({"record": "node", "kind": "route", "name": label or pattern, "qualified_name": q, "line": c.lineno, "end_line": c.end_lineno, "col": c.col_offset, "signature": pattern})
        self.out.append({"record": "edge", "kind": "contains", "source": self.path, "qualified_name": q, "line": c.lineno, "col": c.col_offset})
        view = c.args[1]
        target = dotted(view)
        if target == "include" or target and target.endswith(".include"):
            module = text_of(view.args[0]) if isinstance(view, ast.Call) and view.args else None
            self.ref("imports", module.rsplit(".", 1)[-1] if module else None, c, [module] if module else None, q)
        elif target:
            self.ref("routes_to", target.removesuffix(".as_view").rsplit(".", 1)[-1], c, [target], q)


def extract(path: str, text: str) -> list[dict]:
    w = _Walk(path)
    w.visit(ast.parse(text))
    return w.out
