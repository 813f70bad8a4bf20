"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tidemill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want.fetchall()))
