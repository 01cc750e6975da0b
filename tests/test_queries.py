"""Registered queries against their SQL in DuckDB, and properties of their plans."""

import duckdb
import pytest

import stratigraph.plans  # noqa: F401
from stratigraph import projections, registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HELD = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", HELD)
def test_as_in_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = duck.execute(registry.ORACLES[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    want = sorted((tuple(plain(r[have.index(n)]) for n in names) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str) == want


def test_columns_are_pruned_and_filters_pushed(spark):
    df = projections.project(spark, SF, "SELECT o_orderkey FROM {orders} WHERE o_custkey = 7")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_every_oracle_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 100
