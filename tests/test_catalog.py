"""Every catalog query against its SQL in DuckDB."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from tidemill import catalog

DATA = "/root/testdata/sf0.001"


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert plain(catalog.QUERIES[name](spark, DATA).toPandas()) == plain(con.sql(catalog.ORACLE_SQL[name]).df())
