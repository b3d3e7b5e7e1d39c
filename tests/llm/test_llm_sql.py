"""The numbered operators' SQL in DuckDB against their Spark queries."""

import glob
import os

import duckdb
import pytest

from tidemill.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    wanted, found = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, DATA)
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    assert plain(found.select(*columns).collect()) == plain(wanted.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
