"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

from pathlib import Path

import duckdb
import pytest

from entlink.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in sorted(columns)]) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
