"""A small two-project graph: a shop built on a platform."""

N = "id string, project_id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, decorators string, updated_at bigint"
E = "edge_id bigint, source string, target string, kind string, line int, col int, provenance string"
R = "ref_id bigint, project_id string, from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string, candidates string"


def node(i, kind, name, path, a=1, b=9, qn=None, doc=None, sig=None, deco=None, lang="python"):
    p = i.split("::")[0]
    return (i, p, kind, name, qn or i.split("::", 1)[1], path, lang, a, b, doc, sig, deco, 1)


NODES = [
    node("platform::base.TimeStamped", "model", "TimeStamped", "base/models.py", 1, 20),
    node("platform::base.TimeStamped.created", "field", "created", "base/models.py", 3, 3, sig="DateTimeField()"),
    node("platform::base.AuditLog", "model", "AuditLog", "base/models.py", 22, 40),
    node("platform::base.AuditLog.record", "method", "record", "base/models.py", 25, 30),
    node("shop::orders.Order", "model", "Order", "orders/models.py", 1, 40),
    node("shop::orders.Order.reference", "field", "reference", "orders/models.py", 3, 3, sig="CharField(max_length=32)"),
    node("shop::orders.Order.created", "field", "created", "orders/models.py", 4, 4, sig="DateTimeField()"),
    node("shop::orders.Order.recalculate_totals", "method", "recalculate_totals", "orders/models.py", 10, 15, sig="(self)"),
    node("shop::orders.Order.audit", "method", "audit", "orders/models.py", 17, 22),
    node("shop::orders.checkout_view", "view", "checkout_view", "orders/views.py", 10, 20),
    node("shop::orders.urls.checkout", "route", "checkout", "orders/urls.py", 8, 8, qn="orders/urls.py::route::checkout/"),
    node("shop::tests.test_totals", "function", "test_totals", "orders/tests/test_models.py", 1, 5),
    node("shop::tpl.checkout", "template", "orders/checkout.html", "templates/orders/checkout.html", lang="htmldjango"),
    node("shop::tpl.base", "template", "base.html", "templates/base.html", lang="htmldjango"),
]
EDGES = [
    ("shop::orders.Order", "platform::base.TimeStamped", "extends"),
    ("platform::base.TimeStamped", "platform::base.TimeStamped.created", "contains"),
    ("platform::base.AuditLog", "platform::base.AuditLog.record", "contains"),
    ("shop::orders.Order", "shop::orders.Order.reference", "contains"),
    ("shop::orders.Order", "shop::orders.Order.created", "contains"),
    ("shop::orders.Order", "shop::orders.Order.recalculate_totals", "contains"),
    ("shop::orders.Order", "shop::orders.Order.audit", "contains"),
    ("shop::orders.Order.audit", "platform::base.AuditLog.record", "calls"),
    ("shop::orders.checkout_view", "shop::orders.Order.recalculate_totals", "calls"),
    ("shop::orders.checkout_view", "shop::orders.Order.recalculate_totals", "calls"),
    ("shop::orders.checkout_view", "shop::tpl.checkout", "renders"),
    ("shop::tpl.checkout", "shop::tpl.base", "extends_template"),
    ("shop::tpl.base", "shop::orders.urls.checkout", "resolves"),
    ("shop::orders.urls.checkout", "shop::orders.checkout_view", "routes_to"),
    ("shop::tests.test_totals", "shop::orders.Order.recalculate_totals", "calls"),
    (None, "shop::orders.Order", "calls"),
]


def graph(spark):
    n = spark.createDataFrame(NODES, N)
    e = spark.createDataFrame([(i, s, t, k, i, 0, None) for i, (s, t, k) in enumerate(EDGES)], E)
    r = spark.createDataFrame([(1, "shop", "shop::orders.checkout_view", "notify", "calls", 12, 4, "orders/views.py", "python", None)], R)
    return n, e, r
