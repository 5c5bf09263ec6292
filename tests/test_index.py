"""Resolution, rewrites, sources, extraction, streaming."""

import pytest
from pyspark.sql import functions as F

from symgraph import evaluation as EV
from symgraph import extraction as X
from symgraph.operators import mutations as M
from symgraph.operators import resolution as RES
from symgraph.operators import search as SE
from symgraph.operators import temporal as T
from symgraph.plans import lifecycle
from symgraph.sources import code
from symgraph.streaming.index import IncrementalIndex, bursts, session_recency

from .conftest import DATA, rows
from .fixtures import R, graph, node


def refs(spark, items):
    """``(ref_id, name, kind, candidates[, from, file])`` of project shop."""
    full = [(i, "shop", (rest[0] if rest else "shop::x"), name, kind, 1, 0, (rest[1] if len(rest) > 1 else "orders/views.py"), "python", None) for i, name, kind, _, *rest in items]
    r = spark.createDataFrame(full, R)
    c = spark.createDataFrame([(i, p + 1, v) for i, _, _, cs, *_ in items for p, v in enumerate(cs)], "ref_id bigint, pos int, item string")
    return r, c


def bind(spark, nodes, items, mappings=None):
    r, c = refs(spark, items)
    n = spark.createDataFrame(nodes, __import__("tests.fixtures", fromlist=["N"]).N)
    return {x[0]: (x[1], x[2], x[3]) for x in rows(RES.resolve(r, c, n, mappings), "ref_id", "target", "confidence", "strategy")}


def test_resolution(spark):
    nodes = [
        node("shop::a.helper", "function", "helper", "orders/utils.py"),
        node("shop::b.helper", "function", "helper", "stock/utils.py"),
        node("shop::Only", "class", "Only", "stock/models.py"),
        node("shop::only_field", "field", "only_field", "stock/models.py"),
        node("shop::OrderQuerySet.open", "method", "open", "orders/models.py", qn="orders/models.py::OrderQuerySet.open"),
        node("shop::PartQuerySet.find", "method", "find", "orders/models.py", qn="orders/models.py::PartQuerySet.find"),
        node("shop::OrderManager.find", "method", "find", "orders/models.py", qn="orders/models.py::OrderManager.find"),
        node("shop::BillService.pay", "method", "pay", "bill/services.py", qn="bill/services.py::BillService.pay"),
        node("shop::Cart.total", "method", "total", "cart/models.py", qn="cart/models.py::Cart.total"),
        node("shop::Bag.total", "method", "total", "bag/models.py", qn="bag/models.py::Bag.total"),
        node("shop::self", "function", "selfcall", "orders/views.py"),
        node("shop::models_file", "file", "models.py", "stock/models.py"),
    ]
    q, s, t, su = (RES.MARK + x for x in ("queryset-dispatch", "service-dispatch", "typed-receiver", "super-dispatch"))
    got = bind(
        spark,
        nodes,
        [
            (1, "helper", "calls", []),
            (2, "Only", "extends", []),
            (3, "only_field", "calls", []),
            (4, "open", "calls", [q, "Order"]),
            (5, "find", "calls", [q, "Order"]),
            (6, "filter", "calls", [q, "Order"]),
            (7, "pay", "calls", [s]),
            (8, "total", "calls", [t, "Cart"]),
            (9, "total", "calls", ["bag/models.py::Bag"]),
            (10, "open", "calls", [su]),
            (11, "HELPER", "calls", [], "shop::x", "stock/x.py"),
            (12, "selfcall", "calls", [], "shop::self"),
            (13, "Only", "imports", ["stock.models"]),
            (14, "models", "imports", ["stock"]),
            (15, "nothing", "calls", []),
            (16, "Only", "accesses_member", []),
            (17, None, "calls", []),
            (18, "helper", "extends", []),
        ],
    )
    assert got[1] == ("shop::a.helper", 0.6, "exact") and got[2] == ("shop::Only", 0.9, "exact") and 3 not in got
    assert got[4] == ("shop::OrderQuerySet.open", 0.85, "queryset") and got[5] == ("shop::OrderManager.find", 0.8, "queryset") and 6 not in got
    assert got[7][0] == "shop::BillService.pay" and got[8] == ("shop::Cart.total", 0.9, "typed") and got[9] == ("shop::Bag.total", 0.95, "instance")
    assert 10 not in got and got[11] == ("shop::b.helper", 0.4, "fuzzy") and 12 not in got
    assert got[13] == ("shop::Only", 0.9, "import") and got[14] == ("shop::models_file", 0.85, "module-file")
    assert not {15, 16, 17, 18} & set(got)


def test_reexports_and_aliases(spark):
    nodes = [node("shop::Deep", "class", "Deep", "pkg/impl/deep.py"), node("shop::run", "function", "run", "tools/jobs.py"), node("shop::run2", "function", "run", "other/x.py")]
    content = spark.createDataFrame(
        [("shop", "pkg/__init__.py", "from .impl import Deep as D\n"), ("shop", "pkg/impl/__init__.py", "from .deep import Deep\n"), ("shop", "orders/views.py", "import os, sys as s\nfrom tools.jobs import run as go  # x\nfrom a import (b, c)\n")],
        "project_id string, file_path string, content string",
    )
    m = RES.import_mappings(content)
    assert ("orders/views.py", "go", "run", "tools.jobs") in rows(m, "file_path", "local_name", "exported_name", "source")
    assert ("orders/views.py", "s", "", "sys") in rows(m, "file_path", "local_name", "exported_name", "source")
    got = bind(spark, nodes, [(1, "D", "imports", ["pkg"]), (2, "go", "calls", [])], m)
    assert got[1] == ("shop::Deep", 0.8, "re-export") and got[2] == ("shop::run", 0.8, "import-alias")


def test_scopes(spark):
    nodes = [
        node("shop::a.go", "function", "go", "a/utils.py", qn="a/utils.py::go"),
        node("shop::b.go", "function", "go", "b/utils.py", qn="b/utils.py::go"),
        node("shop::v1", "view", "detail", "a/page_views.py", qn="a/page_views.py::detail"),
        node("shop::v2", "view", "detail", "b/page_views.py", qn="b/page_views.py::detail"),
        node("shop::js", "function", "ajax", "static/one.js", qn="static/one.js::ajax", lang="javascript"),
        node("shop::OrderForm1", "class", "OrderForm", "x/other.py"),
        node("shop::OrderForm2", "class", "OrderForm", "y/forms.py"),
        node("shop::open_js", "function", "open", "static/m.js", qn="static/m.js::open", lang="javascript"),
        node("shop::open_py", "function", "open", "t/x.py", qn="t/x.py::open"),
    ]
    content = spark.createDataFrame([("shop", "c/use.py", "from b.utils import go\n"), ("shop", "c/urls.py", "from a import page_views\n")], "project_id string, file_path string, content string")
    m = RES.import_mappings(content)
    got = bind(
        spark,
        nodes,
        [(1, "go", "calls", [], "shop::x", "c/use.py"), (2, "go", "calls", [], "shop::x", "d/blind.py"), (3, "detail", "routes_to", ["page_views.detail"], "shop::x", "c/urls.py"), (4, "OrderForm", "calls", [], "shop::x", "z.py"), (5, "open", "handles", [], "shop::x", "t.html")],
        m,
    )
    # the import names the function, not its file, so both definitions are seen; the first wins
    assert got[1][0] in ("shop::a.go", "shop::b.go") and got[1][1] == 0.6 and 2 not in got
    assert got[3] == ("shop::v1", 0.9, "scoped") and got[4] == ("shop::OrderForm2", 0.8, "framework") and got[5][0] == "shop::open_js"
    r, _ = refs(spark, [(1, "ajax", "calls", [], "shop::x", "static/two.js")])
    n = spark.createDataFrame(nodes, __import__("tests.fixtures", fromlist=["N"]).N)
    assert rows(RES.scoped_calls(r.withColumn("language", F.lit("javascript")), n, m), "target") == [("shop::js",)]


def test_links_across_projects(spark):
    n = spark.createDataFrame([node("platform::base.Base", "class", "Base", "base/models.py"), node("other::x.Base", "class", "Base", "x/gen_pb2.py"), node("lib::y.Base", "class", "Base", "lib/core.py"), node("lib::z.Solo", "model", "Solo", "lib/z.py")], __import__("tests.fixtures", fromlist=["N"]).N)
    r, c = refs(spark, [(1, "Base", "imports", ["base.models"]), (2, "Base", "imports", ["lib.other"]), (3, "Solo", "relates_to", []), (4, "Base", "relates_to", [])])
    assert rows(RES.link_projects(r, RES.steering(c), n), "ref_id", "target", "confidence") == [(1, "platform::base.Base", 0.85), (2, "lib::y.Base", 0.8)]
    assert rows(RES.link_names(r, n, {"relates_to": ("model", "class")}), "ref_id", "target") == [(3, "lib::z.Solo")]


def test_template_members(spark):
    acc = spark.createDataFrame([("t", "order", "total"), ("t", "item", "name"), ("t", "line", "qty"), ("t", "who", "x")], "template string, head string, attr string")
    ctx = spark.createDataFrame([("v", "order", "Order", False), ("v", "items", "Item", True), ("v", "who", "A", False), ("w", "who", "B", False)], "node string, name string, model string, many boolean")
    loops = spark.createDataFrame([("t", "item", "items"), ("t", "line", "order.lines")], "template string, item string, over string")
    back = spark.createDataFrame([("Order", "lines", "Line")], "model string, accessor string, related string")
    up = spark.createDataFrame([("t", "v"), ("t", "w")], "template string, ancestor string")
    mem = spark.createDataFrame([("Order", "total", "m1"), ("Item", "name", "m2"), ("Line", "qty", "m3"), ("A", "x", "m4"), ("Item", "name", "m2")], "model string, name string, target string")
    assert rows(RES.template_members(acc, ctx, loops, back, up, mem), "path", "target") == [("item.name", "m2"), ("line.qty", "m3"), ("order.total", "m1")]


def test_reverses_externals_redirects(spark):
    r, _ = refs(spark, [(1, "shop:items:list", "resolves", []), (2, "list", "resolves", []), (3, "detail", "resolves", []), (4, "get", "calls", [], "shop::v", "a.py")])
    routes = spark.createDataFrame([("r1", "list", "items"), ("r2", "detail", "items"), ("r3", "detail", "old")], "id string, name string, module string")
    chains = spark.createDataFrame([("items", "shop:items"), ("old", "")], "node string, chain string")
    assert rows(RES.namespaced_reverses(r, routes, chains), "ref_id", "target") == [(1, "r1"), (2, "r1"), (3, "r3")]
    m = spark.createDataFrame([("shop", "a.py", "get", "get", "requests.api"), ("shop", "a.py", "own", "own", "shop.x")], "project_id string, file_path string, local_name string, exported_name string, source string")
    stubs, edges = RES.externals(r, m, spark.createDataFrame([("shop",)], "package string"))
    assert rows(edges, "source", "target") == [("shop::v", "requests::requests.api.get")] and rows(stubs, "name") == [("get",)]
    n = spark.createDataFrame([node("x::base.models.Record", "external", "Record", "", qn="base.models.Record"), node("b::Record", "model", "Record", "base/models.py")], __import__("tests.fixtures", fromlist=["N"]).N)
    assert rows(RES.redirects(n)) == [("x::base.models.Record", "b::Record")]


def test_rewrites(spark):
    n, e, r = graph(spark)
    gone = spark.createDataFrame([("shop", "orders/views.py")], "project_id string, file_path string")
    n2, e2, r2 = M.remove_files(n, e, r, gone)
    assert n.count() - n2.count() == 1 and e.count() - e2.count() == 4 and r2.count() == 0
    bound = spark.createDataFrame([(1, "shop::orders.Order.audit", 0.9, "exact")], "ref_id bigint, target string, confidence double, strategy string")
    new, archive, left = M.commit_resolved(r, bound)
    assert rows(new, "source", "provenance") == [("shop::orders.checkout_view", "resolution:exact")] and left.count() == 0
    again, kept = M.requeue(archive, spark.createDataFrame([("shop::orders.Order.audit",)], "id string"))
    assert again.count() == 1 and kept.count() == 0 and set(again.columns) == set(r.columns)
    assert M.drop_kind(r, "calls").count() == 0
    assert M.replace_project(n, "shop", n.limit(0)).count() == 4
    assert [t.count() for t in M.delete_project("shop", n, e, r)] == [4, 2, 0]
    up = M.upsert(n.select("id", "name"), spark.createDataFrame([("new", "x"), ("shop::tpl.base", "y")], "id string, name string"), ["id"])
    assert up.count() == n.count() + 1 and rows(up.where("id = 'shop::tpl.base'"), "name") == [("y",)]


def test_history(spark):
    touches = spark.createDataFrame([("p", "f", "c1", 1), ("p", "f", "c2", 2), ("p", "f", "c3", 3)], "project_id string, file_path string, commit_hash string, committed_at bigint")
    symbols = spark.createDataFrame([("p", "f", "c1", "a", "1"), ("p", "f", "c1", "b", None), ("p", "f", "c2", "a", "2"), ("p", "f", "c2", "b", None), ("p", "f", "c3", "b", None)], "project_id string, file_path string, commit_hash string, qualified_name string, signature string")
    d = T.diff_revisions(touches, symbols)
    assert rows(d, "commit_hash", "qualified_name", "change_kind", "signature") == [("c1", "a", "added", "1"), ("c1", "b", "added", None), ("c2", "a", "modified", "2"), ("c3", "a", "removed", "2")]
    changes = d.join(touches, ["project_id", "file_path", "commit_hash"])
    assert rows(T.as_of(changes, 2), "qualified_name", "signature") == [("a", "2"), ("b", None)]
    assert rows(T.as_of(changes, 3), "qualified_name") == [("b",)]


def test_version_control_output(spark):
    log = ["h1\x1fAnn\x1f100\x1fFirst", "3\t1\ta/b.py", "-\t-\tlogo.png", "", "h2\x1fBo\x1f200\x1fSecond, with tab\there", "10\t0\tc.py"]
    c, f = code.parse_log(spark.createDataFrame(list(enumerate(log)), "n int, value string"), "p")
    assert rows(c, "commit_hash", "author", "committed_at") == [("h1", "Ann", 100), ("h2", "Bo", 200)]
    assert rows(f, "commit_hash", "file_path", "insertions", "deletions") == [("h1", "a/b.py", 3, 1), ("h1", "logo.png", 0, 0), ("h2", "c.py", 10, 0)]
    diff = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +3,4 @@ def f", "+a", "@@ -9 +12 @@", "@@ -20,3 +0,0 @@", "--- a/y", "+++ /dev/null", "@@ -1 +0,0 @@"]
    h = code.parse_diff(spark.createDataFrame([(1, i, v) for i, v in enumerate(diff)], "diff int, n int, value string"))
    assert rows(h, "file_path", "h_start", "h_end") == [("x", 1, 1), ("x", 12, 12), ("x", 3, 6)]
    s = code.parse_status(spark.createDataFrame([(" M a.py",), ("?? a.py",), ("A  b.py",), ("R  c.py -> d.py",), (" D e.py",)], "value string"))
    assert rows(s, "file_path", "state") == [("a.py", "modified"), ("b.py", "added"), ("d.py", "modified"), ("e.py", "deleted")]


def test_walk_and_extract(spark, tmp_path):
    (tmp_path / "shop" / "tests").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("function x() {}")
    (tmp_path / "shop" / "readme.md").write_text("no")
    (tmp_path / "shop" / "models.py").write_text(
        'from base import models\n\nclass Order(models.TimeStampedModel):\n    """An order."""\n    customer = ForeignKey("crm.Customer", related_name="orders")\n    OPEN = 1\n\n    @property\n    def total(self) -> Money:\n        return self.compute()\n\n    def compute(self, rate: Rate):\n        super().compute()\n        Item.objects.filter(order=self)\n        return settings.RATE\n'
    )
    (tmp_path / "shop" / "urls.py").write_text('from django.urls import path, include\nurlpatterns = [path("go/", views.go, name="go"), path("api/", include("api.urls"))]\n')
    (tmp_path / "shop" / "tests" / "test_order.py").write_text("class OrderViewTests(TestCase):\n    def test_a(self):\n        pass\n")
    (tmp_path / "shop" / "app.js").write_text("import { load } from './load.js';\nexport class Panel extends Base {\n  render(a) { load(a); this.el.on('open', f); }\n}\nconst go = async (x) => { new Panel(x); };\n")
    (tmp_path / "shop" / "a.css").write_text("/* .no */ .card, #top:hover { color: red } @media x { .card .in { } }")
    (tmp_path / "shop" / "t.html").write_text('{% extends "base.html" %}{% comment %}{% url "no" %}{% endcomment %}{% for l in order.lines %}{{ l.qty|money }}{% endfor %}<a class="card" @click="open()" href="{% url \'go\' %}">x</a>')
    (tmp_path / "shop" / "bad.py").write_text("def f(:\n")
    c = code.walk(spark, str(tmp_path), "p")
    assert sorted(x[0] for x in rows(c, "file_path")) == ["shop/a.css", "shop/app.js", "shop/bad.py", "shop/models.py", "shop/t.html", "shop/tests/test_order.py", "shop/urls.py"]
    rec = X.extract(c)
    t = X.tables(rec)
    kinds = {(x[0], x[1]) for x in rows(t["nodes"], "name", "kind")}
    assert {("Order", "model"), ("customer", "field"), ("total", "property"), ("compute", "method"), ("OPEN", "constant"), ("go", "route"), ("Panel", "class"), ("render", "method"), ("go", "function"), ("card", "selector"), ("top", "selector"), ("t.html", "template")} <= kinds
    assert ("no", "selector") not in kinds
    r = {(x[0], x[1]) for x in rows(t["refs"], "reference_kind", "reference_name")}
    assert {("extends", "TimeStampedModel"), ("relates_to", "Customer"), ("reverse_accessor", "Customer"), ("returns", "Money"), ("type_of", "Rate"), ("calls", "compute"), ("reads", "RATE"), ("routes_to", "go"), ("tests", "OrderView"), ("imports", "load"), ("extends", "Base"), ("instantiates", "Panel"), ("extends_template", "base.html"), ("resolves", "go"), ("loop_binding", "l"), ("accesses_member", "qty"), ("uses_tag", "money"), ("styles", "card"), ("handles", "open")} <= r
    assert ("resolves", "no") not in r
    cand = {x[0]: x[1] for x in rows(t["refs"].where("reference_kind = 'calls' AND file_path LIKE '%models.py'"), "reference_name", "candidates")}
    assert "queryset-dispatch" in cand["filter"]
    assert rows(t["errors"], "file_path", "name") == [("shop/bad.py", "SyntaxError")]
    assert ("listen", "open") in rows(t["events"], "role", "event_name")


def test_ignore_files(spark, tmp_path):
    rules = code.ignore_rules("", "# c\n*.gen.py\n/out/\nlogs\n!keep.gen.py\ndocs/**/x.py\n") + code.ignore_rules("sub", "/a.py\n")
    left = [p for p in ("a.gen.py", "b/a.gen.py", "keep.gen.py", "out/a.py", "b/out/a.py", "logs/a.py", "b/logs", "docs/x.py", "docs/a/b/x.py", "x.py", "sub/a.py", "sub/b/a.py", "a.py") if code.is_ignored(p, rules)]
    assert left == ["a.gen.py", "b/a.gen.py", "out/a.py", "logs/a.py", "b/logs", "docs/x.py", "docs/a/b/x.py", "sub/a.py"]
    (tmp_path / "env").mkdir()
    (tmp_path / "migrations").mkdir()
    for p in ("env/a.py", "migrations/b.py", "c.gen.py", "d.py"):
        (tmp_path / p).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("*.gen.py\n")
    assert rows(code.walk(spark, str(tmp_path), "p"), "file_path") == [("d.py",), ("env/a.py",)]


def test_context_types():
    from symgraph.extraction import python

    text = "def view(request, pk):\n    order = get_object_or_404(models.Order, pk=pk)\n    rows = Line.objects.filter(a=1).order_by('b')\n    one = Line.objects.get(pk=1)\n    sub = order.lines.all()\n    last = order.lines.first()\n    x = self.kind.objects.all()\n\n\ny = Line.objects.all()\n"
    got = [(r["kind"], r["name"], r["candidates"]) for r in python.extract("a/views.py", text) if r["record"] == "ref" and r["kind"] in ("context_type", "derived_collection")]
    assert got == [("context_type", "Order", ["order"]), ("context_type", "Line", ["rows", "\x01collection"]), ("context_type", "Line", ["one"]), ("derived_collection", "lines", ["sub", "order"])]


def test_files_without_symbols_are_read_once(spark, tmp_path):
    from symgraph.streaming.index import IncrementalIndex

    index = IncrementalIndex(spark, f"file://{tmp_path}/index")
    content = spark.createDataFrame([("p", "a.py", "x = 1\n"), ("p", "b.txt", "no"), ("p", "c.js", "var a=1;" * 900), ("p", "d.css", ""), ("p", "n.py", None)], "project_id string, file_path string, content string")
    index.apply(content)
    assert rows(index.table.snapshot().where("record = 'skipped'"), "file_path", "name") == [("b.txt", "language"), ("c.js", "minified")]
    assert index.changed_only(content.where("content IS NOT NULL")).count() == 0


def test_blobs_of_commits(spark, tmp_path):
    import shutil
    import subprocess

    if not shutil.which("git"):
        return
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    (tmp_path / "a b.py").write_text("x = 1\n")
    (tmp_path / "bin").write_bytes(b"\xff\xfe\x00")
    run("add", ".")
    run("commit", "-qm", "one")
    first = run("rev-parse", "HEAD")
    (tmp_path / "a b.py").write_text("x = 2\n" * 50_000)
    run("commit", "-qam", "two")
    root = str(tmp_path)
    asked = [(root, first, "a b.py"), (root, "HEAD", "a b.py"), (root, first, "a b.py"), (root, first, "none.py"), (root, first, "bin"), (root, "--all", "a b.py"), ("/nowhere", first, "a"), (None, first, "a")]
    got = {r[:3]: r[3] for r in rows(code.read_blobs(spark.createDataFrame(asked, "root string, commit_hash string, file_path string")))}
    assert got[root, first, "a b.py"] == "x = 1\n" and got[root, "HEAD", "a b.py"] == "x = 2\n" * 50_000
    assert len(got) == 6 and sum(v is None for v in got.values()) == 4


def test_a_failed_batch_owes_a_walk(spark, tmp_path, monkeypatch):
    from symgraph.streaming.index import IncrementalIndex, Snapshot

    C = "project_id string, file_path string, content string"
    tree = {"a.py": "def a():\n    pass\n", "b.py": "def b():\n    pass\n"}
    whole = lambda: spark.createDataFrame([("p", k, v) for k, v in tree.items()], C)
    index = IncrementalIndex(spark, f"file://{tmp_path}/i", whole=whole)
    change = lambda k: spark.createDataFrame([("p", k, tree.get(k), k not in tree, 1)], C + ", deleted boolean, at bigint")
    index.on_batch(change("a.py"), 0)
    monkeypatch.setattr(IncrementalIndex, "apply", lambda *a, **k: 1 / 0)
    try:
        index.on_batch(change("b.py"), 1)
        raise AssertionError
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert index.owed
    tree["c.py"] = "def c():\n    pass\n"
    index.on_batch(change("c.py"), 2)  # the batch names c alone, the walk finds b too
    assert not index.owed and {r[0] for r in rows(index.table.snapshot().where("record = 'node' AND kind = 'function'"), "name")} == {"a", "b", "c"}
    now = [0.0]
    reads = []
    s = Snapshot(lambda: reads.append(1) or len(reads), 5, lambda: now[0])
    assert (s.get(), s.get()) == (1, 1)
    now[0] = 5.0
    assert s.get() == 2


def test_command_line(spark, tmp_path, capsys):
    from symgraph.__main__ import main

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.py").write_text("def a():\n    pass\n")
    table = f"file://{tmp_path}/t"
    assert main(["index", str(tmp_path / "c"), "p", table]) == 0 and "version 1" in capsys.readouterr().out
    (tmp_path / "c" / "a.py").unlink()
    (tmp_path / "c" / "b.py").write_text("def b():\n    pass\n")
    assert main(["index", str(tmp_path / "c"), "p", table]) == 0
    assert main(["status", table]) == 0 and "function" in capsys.readouterr().out
    from symgraph.operators.incremental import VersionedTable

    assert rows(VersionedTable(spark, table).snapshot().where("kind = 'function'"), "name") == [("b",)]
    assert main(["query", "/root/testdata/sf0.001", "kind_counts"]) == 0 and main(["nothing"]) == 2 and main([]) == 2


def test_registered_extractor(spark):
    X.register("css", lambda path, text: [{"record": "node", "kind": "file", "name": path, "qualified_name": path, "line": 1, "end_line": 1}])
    try:
        c = spark.createDataFrame([("p", "a.css", ".x {}")], "project_id string, file_path string, content string")
        assert rows(X.extract(c), "name") == [("a.css",)]
    finally:
        X._REGISTRY.clear()


def changes(spark, items):
    return spark.createDataFrame(items, "project_id string, file_path string, content string, deleted boolean, at bigint")


def plain(index):
    return rows(index.table.snapshot().drop("fingerprint"))


def test_incremental_equals_full(spark, tmp_path):
    import random

    rnd = random.Random(8)
    index = IncrementalIndex(spark, f"file://{tmp_path}/inc")
    state: dict[str, str] = {}
    at = 0
    for batch in range(5):
        items = []
        for _ in range(4):
            at += 1
            path = f"m{rnd.randrange(5)}.py"
            if path in state and rnd.random() < 0.3:
                del state[path]
                items.append(("p", path, None, True, at))
            else:
                state[path] = f"def f{rnd.randrange(9)}():\n    return g{rnd.randrange(9)}()\n"
                items.append(("p", path, state[path], False, at))
        index.on_batch(changes(spark, items), batch)
        index.on_batch(changes(spark, items), batch)  # replayed after a failure
    full = IncrementalIndex(spark, f"file://{tmp_path}/full")
    full.apply(spark.createDataFrame([("p", k, v) for k, v in state.items()], "project_id string, file_path string, content string"))
    assert plain(index) == plain(full)
    assert index.generation == 5
    left = dict(list(state.items())[:1])
    index.refresh(spark.createDataFrame([("p", k, v) for k, v in left.items()], "project_id string, file_path string, content string"))
    assert {x[0] for x in rows(index.table.snapshot(), "file_path")} == set(left)


def test_stream_of_changes(spark, tmp_path):
    items = [("p", "a.py", "def a():\n    pass\n", False, 1), ("p", "b.py", "def b():\n    pass\n", False, 2)]
    changes(spark, items).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    index = IncrementalIndex(spark, f"file://{tmp_path}/t")
    read = lambda: spark.readStream.schema(changes(spark, items).schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    index.follow(read(), f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    changes(spark, [("p", "a.py", None, True, 3)]).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    index.follow(read(), f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert {x[0] for x in rows(index.table.snapshot(), "file_path")} == {"b.py"}


def test_bursts(spark):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    ms = lambda n: t + timedelta(milliseconds=n)
    e = spark.createDataFrame(
        [(ms(0), "p", "a", False, "write"), (ms(300), "p", "b", False, "write"), (ms(350), "p", "c", False, "read"), (ms(2000), "p", "d", True, "write"), (ms(10), "q", "a", False, "write")],
        "ts timestamp, project_id string, path string, is_dir boolean, kind string",
    )
    assert rows(bursts(e), "project_id", "paths", "scope") == [("p", 1, "full"), ("p", 2, "scoped"), ("q", 1, "scoped")]
    assert rows(bursts(e, most=1).where("paths = 2"), "scope") == [("full",)]


def test_session_recency(spark, tmp_path):
    spark.createDataFrame([("p", "a", 0), ("p", "a", 100_000), ("p", "a", 400_000), ("p", "b", 1_000_000)], "project_id string, file_path string, at_ms bigint").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("project_id string, file_path string, at_ms bigint").parquet(f"{tmp_path}/in")
    q = session_recency(s, 1_000_000).writeStream.format("memory").queryName("recency").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    got = {x[0]: x[1:] for x in rows(spark.table("recency"), "file_path", "touches", "recency")}
    assert got["a"] == (2, 0.5) and got["b"] == (1, 1.0)


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "a", 25), ("q3", "c", 1)], "question string, item string, rank int")
    truth = spark.createDataFrame([("q1", "b"), ("q2", "a")], "question string, item string")
    assert rows(EV.reciprocal_rank(ranked, truth)) == [(2, 0.25)]
    got = rows(EV.accuracy(ranked, truth, ["question"], "item"), "question", "precision", "recall")
    assert got == [("q1", 0.5, 1.0), ("q2", 1.0, 1.0), ("q3", 0.0, 0.0)]


def test_search_parts(spark):
    n, e, _ = graph(spark)
    assert rows(SE.search_nodes(n, "recalculate_totals", 5), "id", "way")[0] == ("shop::orders.Order.recalculate_totals", 0)
    assert rows(SE.uncovered(n.select("id"), n, e), "name")[:2] == [("AuditLog",), ("Order",)]
    f = SE.focused(n, n.where("name = 'audit'").select("id"), 1)
    assert rows(f, "id") == [("shop::orders.Order.audit",), ("shop::orders.Order.recalculate_totals",)]
    texts = spark.createDataFrame([(1, "sessions and imports"), (2, None), (3, "")], "k int, t string")
    assert rows(SE.bm25_stemmed(texts, ["k"], "t", ["session"]), "k", "matched") == [(1, 1)]
    assert SE.bm25_stemmed(texts, ["k"], "t", []).count() == 0 == SE.bm25(texts, ["k"], "t", []).count()
    assert rows(SE.document_frequencies(n, "order models"), "term", "files") == [("models", 3), ("order", 2)]


def test_words_of_a_stem_begin_like_it():
    """What the stemmed search relies on, over all endings that the stemmer knows."""
    from symgraph.functions.porter import stem

    roots = ["relat", "condit", "ration", "valenc", "hesit", "digit", "conform", "radic", "different", "vile", "analog", "vietnam", "predic", "oper", "feud", "decis", "hope", "call", "form", "sensit", "sens", "tripl", "electr", "hop", "tan", "fall", "hiss", "fizz", "fail", "fil", "happ", "sk", "ab"]
    ends = ["", "s", "es", "ies", "ed", "ing", "y", "ational", "tional", "enci", "ency", "anci", "izer", "abli", "ably", "alli", "ally", "entli", "eli", "ousli", "ously", "ization", "ation", "ator", "alism", "iveness", "fulness", "ousness", "aliti", "ality", "iviti", "ivity", "biliti", "bility", "icate", "ative", "alize", "iciti", "icity", "ical", "ful", "ness", "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ity", "ous", "ive", "ize", "e", "ll"]
    for w in (r + e for r in roots for e in ends):
        q = stem(w)
        assert w.startswith(q[: max(1, len(q) - 2)]), (w, q)


def test_an_index_of_postings(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "")], "k int, t string")
    posts = SE.postings(texts, ["k"], "t")
    SE.write_postings(posts, f"file://{tmp_path}/p", 4)
    got = SE.read_postings(spark.read.parquet(f"file://{tmp_path}/p"), ["b", "c"], 4)
    assert rows(got, "k", "term", "tf", "size") == [(1, "b", 2, 3), (2, "b", 1, 2), (2, "c", 1, 2)]


def test_modules_by_endings_equal_all_pairs(spark):
    import random

    rnd = random.Random(4)
    part = lambda: rnd.choice(["a", "ab", "b", "cab"])
    nodes = [(i, rnd.choice("xy"), "/".join(part() for _ in range(rnd.randrange(1, 4))) + rnd.choice([".py", "/__init__.py"])) for i in range(60)]
    asked = [(i, rnd.choice("xyz"), ".".join(part() for _ in range(rnd.randrange(1, 4)))) for i in range(40)] + [(99, "x", ""), (98, "x", None)]
    dotted = lambda p: p.rsplit(".", 1)[0].removesuffix("/__init__").replace("/", ".")
    got = RES.by_module(spark.createDataFrame(asked, "r int, name string, module string"), spark.createDataFrame(nodes, "id int, name string, file_path string"))
    want = sorted((r, i) for r, name, m in asked if m for i, n, p in nodes if n == name and (dotted(p).endswith(m) or m.endswith(dotted(p))))
    assert [tuple(x) for x in rows(got, "r", "id")] == sorted(want, key=repr) and len(want) > 20


def test_links_of_a_name_in_many_projects_equal_all_pairs(spark):
    import random

    rnd = random.Random(5)
    projects = ["a", "ab", "b", "cab", None]
    part = lambda: rnd.choice(["a", "ab", "b", "cab", "c"])
    path = lambda sep: sep.join(part() for _ in range(rnd.randrange(1, 4)))
    nodes = [(f"{rnd.randrange(9)}::{i}", rnd.choice(projects), "class" if i % 9 else "import", rnd.choice("xyzuvw"), path("/") + rnd.choice([".py", "/__init__.py", "_pb2.py"])) for i in range(90)]
    nodes += [("0::u", "b", "class", "u", None), ("1::solo", "ab", "class", "solo", "c/d.py")]
    asked = [(i, rnd.choice(projects), rnd.choice("xyzuvw"), path(".")) for i in range(120)] + [(200, "a", "x", ""), (201, "a", "x", None), (202, "a", None, "ab"), (203, "b", "solo", "ab.z"), (204, "ab", "solo", "ab.z")]
    n = spark.createDataFrame(nodes, "id string, project_id string, kind string, name string, file_path string")
    r = spark.createDataFrame(asked, "ref_id int, project_id string, reference_name string, plain string").withColumn("reference_kind", F.lit("imports"))
    held = [(i, to, name, p.rsplit(".", 1)[0].removesuffix("/__init__").replace("/", ".") if p else "") for i, to, kind, name, p in nodes if kind == "class" and to and not (p or "").endswith("_pb2.py")]
    want = []
    for ref, own, name, module in asked:
        if own is None or name is None or module is None:
            continue
        first = [i for i, to, x, d in held if x == name and to != own and d and module and (d.endswith(module) or module.endswith(d))]
        package = module.split(".")[0]
        sole = [i for i, to, x, _ in held if x == name and to == package]
        if first:
            want.append((ref, min(first), 0.85))
        elif package != own and len(sole) == 1:
            want.append((ref, sole[0], 0.8))
    assert {c for _, _, c in want} == {0.8, 0.85}
    steer = r.select("ref_id", "plain")
    for got in (RES.link_projects(r, None, n), RES.link_projects(r.drop("plain"), steer, n)):
        assert rows(got, "ref_id", "target", "confidence") == sorted(want, key=repr)


def test_plan_of_links_stays_small(spark):
    df = lifecycle.registry.queries["link_projects"](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # the driver holds plans and the state of every exchange; nodes and edges are read before
    assert plan.count("Exchange ") <= 20 and "nodes.parquet" not in plan and "edges.parquet" not in plan


def test_receivers(spark):
    N = "id string, project_id string, kind string, name string, file_path string, qualified_name string"
    nodes = spark.createDataFrame(
        [("C", "p", "class", "Cart", "a.py", "a.Cart"), ("C.go", "p", "method", "go", "a.py", "a.Cart.go"), ("B", "p", "class", "Base", "a.py", "a.Base"), ("B.up", "p", "method", "up", "a.py", "a.Base.up"), ("T1", "p", "class", "Twin", "a.py", "a.Twin"), ("T2", "p", "class", "Twin", "b.py", "b.Twin")], N
    )
    edges = spark.createDataFrame([("C", "C.go", "contains"), ("B", "B.up", "contains"), ("C", "B", "extends")], "source string, target string, kind string")
    refs = spark.createDataFrame([(1, "p", "f.py", "go", "calls"), (2, "p", "f.py", "up", "calls"), (3, "p", "f.py", "go", "calls"), (4, "p", "f.py", "go", "calls"), (5, "p", "f.py", "none", "calls")], "ref_id int, project_id string, file_path string, reference_name string, reference_kind string")
    steer = spark.createDataFrame([(1, True, "Cart"), (2, True, "m.Cart"), (3, False, "Order.cart"), (4, True, "Twin"), (5, False, "C")], "ref_id int, typed boolean, plain string")
    inherited = spark.createDataFrame([("C", "up", "B.up")], "cls string, name string, method string")
    typed = RES.typed_classes(refs, steer, nodes)
    assert rows(typed) == [(1, "C"), (2, "C")]
    related = RES.related_classes(refs, steer, spark.createDataFrame([("Order", "cart", "Cart")], "owner string, accessor string, related string"), nodes)
    assert rows(related) == [(3, "C")]
    mappings = spark.createDataFrame([("p", "f.py", "C", "Cart", "a")], "project_id string, file_path string, local_name string, exported_name string, source string")
    assert rows(RES.imported_classes(refs, steer, mappings, nodes)) == [(5, "C")]
    every = typed.unionByName(related)
    assert rows(RES.receiver_calls(refs, every, edges, nodes, inherited), "ref_id", "target") == [(1, "C.go"), (2, "B.up"), (3, "C.go")]


def test_imports_over_lines(spark):
    text = "from m import (\n    one,  # first\n    two as zwei,\n)\nimport os.path, re as rx  # both\nfrom . import x\nif a:\n    from b.c import d\n"
    got = rows(RES.import_mappings(spark.createDataFrame([("p", "a.py", text), ("p", "b.js", text), ("p", "n.py", None)], "project_id string, file_path string, content string")), "local_name", "exported_name", "source")
    assert got == sorted([("one", "one", "m"), ("zwei", "two", "m"), ("os.path", "", "os.path"), ("rx", "", "re"), ("x", "x", "."), ("d", "d", "b.c")], key=repr)
