"""Every registered query of the corpus operators runs; those with SQL give the rows DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA

from quillmill import registry

SF = DATA / "sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(SF))
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows) == expected
