import math

import pytest
from pyspark.sql import functions as F

from symgraph.functions import arguments as A
from symgraph.functions import domain as D
from symgraph.functions import predicates as P
from symgraph.functions.porter import stem

from .conftest import rows


def values(spark, data, make):
    df = spark.createDataFrame([(i, *x) if isinstance(x, tuple) else (i, x) for i, x in enumerate(data)], "i int, a string" + (", b string" if data and isinstance(data[0], tuple) else ""))
    return [r[0] for r in df.orderBy("i").select(make.alias("v")).collect()]


def test_paths(spark):
    paths = ["app/tests/x.py", "app\\Test\\x.py", "test_a.py", "conftest.py", "a/b_test.py", "x.spec.js", "contest/latest.py", "tests.py", None]
    assert values(spark, paths, P.is_test_path("a")) == [True, True, True, True, True, True, False, False, None]
    paths = ["a/migrations/1.py", "b/x.min.js", "x_pb2.py", "Vendor/a.py", "vendors/a.py", "migrations.py"]
    assert values(spark, paths, P.is_generated_path("a")) == [True, True, True, True, False, False]
    assert values(spark, ["m/management/commands/x.py", "management/x/commands/y.py"], P.is_command_path("a")) == [True, False]
    assert values(spark, ["a/b/c.py", "a\\b\\__init__.py", "x"], P.dotted_module("a")) == ["a.b.c", "a.b", "x"]
    assert values(spark, ["a/b.min.js", "c"], P.file_stem("a")) == ["b.min", "c"]
    assert values(spark, ["a/b/c/d.py", "d.py", "a/d.py"], P.directory_at("a", 2)) == ["a/b", "(root)", "a"]
    assert values(spark, ["app/company/contact/urls/__init__.py", "urls.py", "shop/urls.py"], P.url_scope("a")) == ["company/contact", None, "shop"]
    assert values(spark, [("a/b/x.py", "a/b/y.py"), ("a/b/x.py", "a/c/y.py"), ("x.py", "y.py"), ("a/b/c/x", "a/z/c/y")], P.shared_depth("a", "b")) == [2, 1, 0, 1]


def test_names(spark):
    assert values(spark, ["ForeignKey(Location, related_name='x')", "CharField(x)", "ForeignKey(to=A)", "OneToOneField(User)", "ForeignKey"], P.relation_target("a")) == ["Location", None, None, "User", None]
    assert values(spark, [("verify_password", "a"), ("Rotate", "auth/keys.py::Rotate"), ("label", "text::label")], P.security_keyword("a", "b")) == ["password", "auth", None]
    assert values(spark, ["a/b.py::Sync.save", "x.Sync.save", "MySync.save", "Sync.save"], P.qualified_ends_with("a", "Sync.save")) == [True, True, False, True]
    assert values(spark, [("__str__", "a.py"), ("save", "a.py"), ("ShopConfig", "a.py"), ("f", "a/admin.py"), ("f", "a.py")], P.is_framework_reached("a", "b")) == [True, True, True, True, False]
    assert values(spark, ["detail_view", "app/orders/models.py", "reorder"], P.glob("*_view", "a")) == [True, False, False]
    assert values(spark, ["order", "Rorder", "x" * 4097], P.glob("?rder", "a")) == [True, False, False]
    assert values(spark, ["x" * 2001, "short\n" * 900], P.is_minified_source("a")) == [True, False]
    assert values(spark, ['["Shop"]', None, "[]"], P.qualify_handler("a", F.lit("save"))) == ["Shop.save", "save", "save"]


def test_recency(spark):
    got = values(spark, ["0", "3", "8", "-1"], F.round(P.commit_recency(F.col("a").cast("double")), 6))
    assert got == [1.0, round(math.exp(-0.231 * 3), 6), 0.0, 0.0]
    assert values(spark, ["10"], P.recency_bonus(F.lit(10), F.lit(1.0))) == [3]


def test_arguments():
    assert A.parse_date("1970-01-02") == 86_400 and A.format_date(86_400) == "1970-01-02"
    assert A.parse_date("2024-02-31") == A.parse_date("2024-03-02")
    for bad in ("2024-13-01", "x", "2024-01-32"):
        with pytest.raises(ValueError):
            A.parse_date(bad)
    assert A.query_tokens("How does the Load_order get unloaded, ab?") == ["load_order", "unloaded"]
    assert A.check_revision("main~2") == "main~2"
    for bad in ("", "-x", "a b", "a\x01", "x" * 300):
        with pytest.raises(ValueError):
            A.check_revision(bad)
    assert A.decode_cursor(A.encode_cursor(40, 3), 3) == (40, None)
    assert A.decode_cursor("40.2", 3)[0] == 0 and A.decode_cursor(None, 3) == (0, None)
    assert A.explore_budget(0) == 40_000 and A.explore_budget(10**6) == 64_000
    assert A.truncate_at("añb", 2) == "a" and A.approximate_tokens("abcde") == 2


def test_weights_sum_to_one():
    assert abs(sum(D.CRITICALITY.values()) - 1) < 1e-9 and abs(sum(D.RISK.values()) - 1) < 1e-9
    from symgraph.operators.risk import weights

    for churn in (True, False):
        for flow in (True, False):
            assert abs(sum(weights(churn, flow).values()) - 1) < 1e-9


def test_stems():
    # from the published vocabulary
    known = dict(caresses="caress", ponies="poni", cats="cat", agreed="agre", plastered="plaster", motoring="motor", hopping="hop", filing="file", happy="happi", relational="relat", vietnamization="vietnam", triplicate="triplic", hopeful="hope", adjustment="adjust", probate="probat", controll="control", sky="sky", generalizations="gener", oscillators="oscil")
    assert {w: stem(w) for w in known} == known


def test_overlap(spark):
    df = spark.createDataFrame([(1, 5, 3, 9), (1, 2, 5, 6), (4, 4, 1, 9)], "a int, b int, c int, d int")
    assert rows(df.select(P.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")))) == [(0,), (1,), (3,)]


def test_left_join_spreads_null_keys(spark):
    from pyspark.sql import functions as F

    from symgraph.sources.tables import left_join

    left = spark.range(900).withColumn("k", F.when(F.col("id") % 3 == 0, F.col("id") % 7))
    right = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = left_join(left, right, ["k"], "id")
        assert {(r["k"], r["v"]) for r in got.collect()} == {(None, None)} | {(i, 2 * i) for i in range(7)} and got.count() == 900
        most = max(r["count"] for r in got.where("k IS NULL").groupBy(F.spark_partition_id()).count().collect())
        assert most < 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_kept_tables_are_freed(spark):
    import pytest

    from symgraph.session import Scratch, release

    scratch = Scratch(spark, "freed")
    df = scratch.keep(scratch.write(spark.range(3)))
    assert df.count() == 3 and scratch.rows(df) == 3 and scratch.size(df) > 0
    assert release(spark) >= 1 and release(spark) == 0
    with pytest.raises(Exception):
        df.count()
