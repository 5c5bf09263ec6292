import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SYMGRAPH_DRIVER_MEMORY", "4g")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from symgraph.session import get_spark

    s = get_spark("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df, *columns):
    """The rows of a small result as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def same(spark_rows, duck_rows):
    import math

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        if isinstance(v, (list, tuple)):
            return tuple(map(norm, v))
        return v

    a = sorted((tuple(map(norm, r)) for r in spark_rows), key=repr)
    b = sorted((tuple(map(norm, r)) for r in duck_rows), key=repr)
    return a == b


def check_sql(spark, name, fn, sql, d=DATA):
    import duckdb

    df = fn(spark, d)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{d}/{t}'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    assert sorted(rel.columns) == columns
    assert same(got, want), f"{name}: {len(got)} rows, SQL {len(want)}"
