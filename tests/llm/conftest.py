import sys
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table():
    """Rows of a test table as tuples of the named columns."""

    def rows(name, *columns):
        found = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pydict()
        return list(zip(*(found[c] for c in columns), strict=True))

    return rows


@pytest.fixture
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from rows, with more columns whose names operators use themselves."""

    def make(rows, id_type="long"):
        ddl = f"doc_id {id_type}, text string, row string, n long, words string, hash string, file string, kept boolean"
        return spark.createDataFrame([(*r, "r", 7, "w", "h", "f", True) for r in rows], ddl).repartition(3)

    return make

