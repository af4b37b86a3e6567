"""Every registered query against its SQL, on the smallest given tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        name = file.removesuffix(".parquet")
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{file}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "null" if math.isnan(x) else repr(x + 0.0)
        return "null" if x is None else str(x)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), result.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_columns_and_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def plan(name):
        df = entry.queries()[name](spark, SF_DIR)
        return df._jdf.queryExecution().toString()

    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan("demographic_risk")
    filtered = plan("dash_filtered")
    assert "GreaterThanOrEqual(ts," in filtered and "In(event_type, [click,view])" in filtered


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert "age_adjusted_risk" in df.columns
    assert df.count() > 0
