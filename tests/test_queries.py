"""Every core query with SQL equals it on the smallest data; every other one runs."""

import pytest

import __spark_entry__ as entry
from symgraph.plans import analysis, lifecycle, pipeline, relational

from .conftest import DATA, check_sql

REG = [pipeline.registry, relational.registry, analysis.registry, lifecycle.registry]
WITH_SQL = [(n, r) for r in REG for n in r.queries if n in r.sql]
WITHOUT = [(n, r) for r in REG for n in r.queries if n not in r.sql]


@pytest.mark.parametrize("name,reg", WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_equals_sql(spark, name, reg):
    check_sql(spark, name, reg.queries[name], reg.sql[name])


@pytest.mark.parametrize("name,reg", WITHOUT, ids=[n for n, _ in WITHOUT])
def test_runs(spark, name, reg):
    df = reg.queries[name](spark, DATA)
    got = df.collect()
    assert len({repr(r) for r in got}) == len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_count_does_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(repr, analysis.registry.queries["flows"](spark, DATA).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
