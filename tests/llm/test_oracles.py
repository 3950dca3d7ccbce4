"""Queries of this subpackage with SQL give DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from entlink.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, str(DATA))
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(map(tuple, found.fetchall()))
