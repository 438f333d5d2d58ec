"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from pagegrain.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = QUERIES[name](spark, D).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)
