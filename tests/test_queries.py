"""Every registered query against its SQL in DuckDB."""

import check
import duckdb
import pytest
from conftest import SF

import __spark_entry__ as contract

ORACLE = contract.oracle_sql()
QUERIES = contract.queries()
ML = [name for name in QUERIES if name not in ORACLE]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in found.description}
    columns = list(types)
    theirs = check.rows_of(found.fetchall(), columns)
    assert check.rows_of([tuple(r) for r in df.collect()], df.columns) == theirs
    assert {f.name: check.SAME[f.dataType.simpleString()] for f in df.schema} == types


@pytest.mark.parametrize("name", sorted(ML))
def test_model_queries_return_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 3908
