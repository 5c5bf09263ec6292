import random

import pytest
from pyspark.sql import functions as F

from symgraph.engine import Engine, Profile
from symgraph.operators import flows as FL
from symgraph.operators import graph as GR
from symgraph.operators import reads as R
from symgraph.operators import risk as RK
from symgraph.operators.winnow import parse, winnow

from .conftest import rows
from .fixtures import graph


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark)


def test_impact_of_a_method(spark, g):
    n, e, _ = g
    seeds = spark.createDataFrame([("s", "shop::orders.Order.recalculate_totals")], "seed string, node string")
    got = rows(GR.impact(seeds, e, n, 2), "level", "node", "kind", "reached")
    assert got == [(1, "shop::orders.checkout_view", "calls", True), (2, "shop::orders.urls.checkout", "routes_to", True)]


def test_flows(spark, g):
    f, m = FL.compute(*g)
    got = {r[0]: r[1:] for r in rows(f, "name", "entry_kind", "nodes", "files", "apps", "projects", "depth_max")}
    # the page's link back to its own route ends there
    assert got["orders checkout/"] == ("route", 5, 5, 2, 0, 3)
    assert got["orders.Order.audit"] == ("true_root", 2, 2, 2, 1, 1)
    assert all(0 <= r[0] <= 1 for r in rows(f, "criticality"))
    assert FL.participation(f, m).where("node = 'shop::tpl.base'").count() == 1
    assert FL.as_records(f, m).count() == f.count()


def test_flows_after_a_change_equal_a_full_computation(spark, g):
    n, e, r = g
    f, m = FL.compute(n, e, r)
    changed = spark.createDataFrame([("shop", "orders/views.py")], "project_id string, file_path string")
    e2 = e.where("kind <> 'renders'")
    f1, m1 = FL.retrace(changed, n, e2, r, f, m)
    f2, m2 = FL.compute(n, e2, r)
    assert rows(f1.select(*f2.columns)) == rows(f2) and rows(m1) == rows(m2)


def test_model_fields_shadow(spark, g):
    n, e, _ = g
    got = rows(GR.model_fields(e, n).where("model = 'shop::orders.Order'"), "name", "base", "depth", "shadowed")
    assert got == [("created", "platform::base.TimeStamped", 1, True), ("created", "shop::orders.Order", 0, False), ("reference", "shop::orders.Order", 0, False)]


def test_shortest_path(spark, g):
    _, e, _ = g
    pairs = spark.createDataFrame([("shop::orders.urls.checkout", "shop::tpl.base"), ("shop::tpl.base", "shop::nothing")], "source string, target string")
    assert rows(GR.shortest_paths(pairs, e), "hops", "path") == [(3, ["shop::orders.urls.checkout", "shop::orders.checkout_view", "shop::tpl.checkout", "shop::tpl.base"])]


def test_reach_is_bounded_and_marked(spark):
    steps = spark.createDataFrame([("a", f"b{i:02}") for i in range(30)], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a"), ("x", "x")], "seed string, node string")
    got = GR.reach(seeds, steps, 3, most=10)
    assert got.where("seed = 'a'").count() == 10 and got.where("truncated").count() == 10
    assert got.where("seed = 'x' AND NOT truncated").count() == 1


def test_restart_walk_against_power_iteration(spark):
    rnd = random.Random(3)
    ids = [f"n{i}" for i in range(12)]
    pairs = [(rnd.choice(ids[:10]), rnd.choice(ids[:10])) for _ in range(30)]
    n = spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame(pairs, "source string, target string")
    seeds = ["n0", "n3", "n3", "n11"]
    adj = {i: [] for i in ids}
    for a, b in pairs:
        adj[a].append(b)
        adj[b].append(a)
    rank = dict.fromkeys(ids, 0.0)
    for s in set(seeds):
        rank[s] = 1 / len(seeds)
    for _ in range(20):
        nxt = dict.fromkeys(ids, 0.0)
        for a in ids:
            for b in adj[a]:
                nxt[b] += 0.85 * rank[a] / len(adj[a])
        for s in set(seeds):
            nxt[s] += 0.15 / len(seeds)
        rank = nxt
    got = {r[0]: r[1] for r in rows(GR.restart_walk(spark.createDataFrame([(s,) for s in seeds], "id string"), e, n), "id", "rank")}
    assert set(got) == {i for i in ids if rank[i] > 0}
    assert all(abs(got[i] - rank[i]) < 1e-9 for i in got)


def test_inherited_methods_abstain(spark):
    n = spark.createDataFrame([("A.f", "method", "f"), ("B.f", "method", "f"), ("C", "class", "C"), ("A", "class", "A"), ("B", "class", "B"), ("A.g", "method", "g"), ("R.g", "method", "g")], "id string, kind string, name string")
    e = spark.createDataFrame([("C", "A", "extends"), ("C", "B", "extends"), ("A", "R", "extends"), ("A", "A.f", "contains"), ("B", "B.f", "contains"), ("A", "A.g", "contains"), ("R", "R.g", "contains"), ("R", "A", "extends")], "source string, target string, kind string")
    got = rows(GR.inherited_methods(e, n).where("cls = 'C'"))
    assert got == [("C", "g", "A.g")]  # f is ambiguous at its depth


def test_chains(spark):
    p = spark.createDataFrame([("c", "b", "items"), ("b", "a", "shop"), ("a", None, ""), ("x", "y", "x"), ("y", "x", "y")], "node string, parent string, name string")
    got = {r[0]: r[1] for r in rows(GR.chain_concat(p)) if r[0] in "abc"}
    assert got == {"a": "", "b": "shop", "c": "shop:items"}


def test_winnow_arguments():
    assert [c.axis for c in parse([("calls", "contains", "x"), ("tested", "eq", "no"), ("kind", "==", "model")])] == ["kind", "tested", "calls"]
    for bad in [("kind", "is", "model"), ("colour", "eq", "x"), ("risk", ">=", "2"), ("kind", "eq", "modle"), ("tested", "eq", "maybe"), ("name", "eq", " ")]:
        with pytest.raises(ValueError):
            parse([bad])
    with pytest.raises(ValueError):
        parse([("kind", "eq", "model")] * 13)


def test_winnow_axes(spark, g):
    n, e, r = g
    f, m = FL.compute(n, e, r)
    ask = lambda *c, **k: [x[0].split("::")[1] for x in rows(winnow(n, e, list(c), k.pop("rank", "name"), None, f, m, **k), "id")]
    assert ask(("tested", "eq", "true"), ("kind", "eq", "method")) == ["orders.Order.recalculate_totals"]
    assert ask(("called_by", "contains", "checkout_v"), ("kind", "eq", "method")) == ["orders.Order.recalculate_totals"]
    assert ask(("extends", "contains", "timestamped")) == ["orders.Order"]
    assert ask(("in_flow", "contains", "checkout/"), ("kind", "eq", "template")) == ["tpl.base", "tpl.checkout"]
    assert ask(("in_flow", "eq", "false"), ("kind", "eq", "template")) == []
    assert ask(("lines", ">=", "40")) == ["orders.Order"]
    assert ask(("callers", ">=", "2")) == ["orders.Order.recalculate_totals"]
    assert ask(("name", "matches", "a?dit*"), ("project", "eq", "SHOP")) == ["orders.Order.audit"]
    changes = spark.createDataFrame([("orders.Order.audit", 10)], "qualified_name string, committed_at bigint")
    assert ask(("changed_since", ">=", "1970-01-01"), changed=changes) == ["orders.Order.audit"]
    churn = spark.createDataFrame([("shop", "orders/views.py", 20)], "project_id string, file_path string, commits bigint")
    got = rows(winnow(n, e, [("kind", "eq", "view")], "risk", None, f, m, churn), "churn", "callers", "covered")
    assert got == [(20, 1, False)]


def test_changed_symbols_and_reasons(spark, g):
    n, e, r = g
    touched = spark.createDataFrame([("shop::orders.Order.recalculate_totals", 6), ("shop::tests.test_totals", 2)], "node_id string, lines bigint")
    got = {x[0]: x[1:] for x in rows(RK.changed(touched, n, e, None, None), "id", "callers", "covering", "reasons", "risk")}
    assert got["shop::orders.Order.recalculate_totals"][:2] == (2, 1)
    assert got["shop::orders.Order.recalculate_totals"][2].startswith("only 1 covering test(s)")
    assert got["shop::tests.test_totals"][1] == 5


def test_engine_tools(spark, g):
    n, e, r = g
    en = Engine(n, e, r, profile=Profile(hooks=("audit",)))
    # containment comes last
    assert [r["other"] for r in en.callers("Order.recalculate_totals").collect()] == ["shop::orders.checkout_view", "shop::tests.test_totals", "shop::orders.Order"]
    assert rows(en.callees("checkout_view"), "other", "times") == [("shop::orders.Order.recalculate_totals", 2), ("shop::tpl.checkout", 1)]
    assert rows(en.subclasses("TimeStamped"), "node", "depth") == [("shop::orders.Order", 1)]
    assert rows(en.routes(), "name", "view", "template") == [("checkout", "shop::orders.checkout_view", "shop::tpl.checkout")]
    assert rows(en.tests("recalculate_totals"), "source") == [("shop::tests.test_totals",)]
    assert rows(en.at("views.py", 15), "name") == [("checkout_view",)]
    assert rows(en.node("Order"), "role", "import_line") == [("model", "from orders.models import Order")] or en.node("Order").count() == 1
    assert en.path("checkout", "base.html").first()["hops"] == 3
    assert "audit" not in [x[0] for x in rows(en.orphans(), "name")]
    assert en.search("chckvw").count() == 1 and en.search("order").count() >= 1
    assert en.flows("checkout").count() == 1
    assert rows(en.enrich("recalculate_totals"), "callers", "tests", "flows") == [(2, 1, 1)]
    page, cursor, note = en.page(en.overview(), None, 2)
    assert page.count() == 2 and cursor == "2.0" and note is None
    assert en.winnow([("kind", "eq", "model")], "risk").count() == 3
    assert rows(en.winnow_cascade([("kind", "eq", "model"), ("callers", ">", "5")]), "step", "left") == [(0, 14), (1, 3), (2, 0)]


def test_nothing(spark, g):
    n, e, r = (x.limit(0) for x in g)
    f, m = FL.compute(n, e, r)
    assert f.count() == 0 and m.count() == 0
    assert GR.subclasses(e).count() == 0
    assert GR.restart_walk(n.select("id"), e, n).count() == 0
    assert winnow(n, e, [("kind", "eq", "model")], "risk", None).count() == 0


def test_hubs_walk_alike(spark, g):
    n, e, _ = g
    seeds = n.where("kind = 'view'").select("id")
    plain = {r[0]: r[1] for r in rows(GR.restart_walk(seeds, e, n), "id", "rank")}
    for hub in (1, 3):  # all nodes, or some, are hubs
        got = {r[0]: r[1] for r in rows(GR.restart_walk(seeds, e, n, hub=hub), "id", "rank")}
        assert set(got) == set(plain) and all(abs(got[k] - plain[k]) < 1e-12 for k in plain)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("symgraph_")]


def test_marks_of_cut_listings(spark, g):
    n, e, _ = g
    seeds = n.where("name = 'recalculate_totals'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    whole = GR.impact(seeds, e, n, 2)
    assert whole.count() == 2 and not whole.where("truncated").count()
    cut = GR.impact(seeds, e, n, 2, most=1)
    assert rows(cut, "level", "truncated") == [(1, True)]
    views = n.where("kind = 'view'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    assert {r[0] for r in rows(GR.feature(views, e, n, most=2), "truncated")} == {True}


def test_models_alone(spark, g):
    n, e, _ = g
    one = n.where("name = 'Order'").select("id")
    every = GR.model_fields(e, n)
    assert rows(GR.model_fields(e, n, one)) == rows(every.join(one.withColumnRenamed("id", "model"), "model", "left_semi").select(*every.columns))
    more = e.unionByName(spark.createDataFrame([(90, "shop::orders.Order", "platform::base.AuditLog", "relates_to", 1, 0, None), (91, "shop::orders.Order", "platform::base.AuditLog", "relates_to", 2, 0, None), (92, "platform::base.AuditLog", "shop::orders.Order", "relates_to", 1, 0, "synthesis:reverse")], e.schema))
    assert rows(R.model_relations(one, more, n), "direction", "name") == [("to", "AuditLog")]


def test_reach_is_cut_within_levels(spark):
    """A hub far down and a limit: the first nodes by depth and id, and a mark."""
    steps = [("s", "a"), ("a", "b"), *[("b", f"h{i:03}") for i in range(40)], ("t", "x")]
    seeds = spark.createDataFrame([("s", "s"), ("t", "t")], "seed string, node string")
    df = spark.createDataFrame(steps, "src string, dst string")
    for depth, small in ((3, 0), (9, 0), (9, 1000)):
        got = rows(GR.reach(seeds, df, depth, most=6, small=small))
        assert got == sorted([("s", "s", 0, True), ("s", "a", 1, True), ("s", "b", 2, True), *[("s", f"h{i:03}", 3, True) for i in range(3)], ("t", "t", 0, False), ("t", "x", 1, False)], key=repr)
