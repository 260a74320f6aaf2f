"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(table, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted([tuple(r[i] for i in at) for r in table], key=lambda r: [(v is None, str(type(v)), v) for v in r])


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    rel = duck.sql(contract.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert ordered(df.collect(), df.columns, columns) == ordered(rel.fetchall(), rel.columns, columns)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() > 0
