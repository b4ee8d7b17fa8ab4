"""Every registered query of the core against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from millrace.plans import queries as core

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = core.queries(), core.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == {"code_chunks", "json_structure", "shortened", "shortened_modes"}  # tested in test_sources and test_shorten


@pytest.mark.parametrize("name", ["code_chunks", "json_structure", "shortened", "shortened_modes"])
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
