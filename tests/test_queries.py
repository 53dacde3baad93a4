"""Every query with SQL against DuckDB on the smallest tables, and every other one for a stable schema."""

import math
from pathlib import Path

import duckdb
import pytest

from arbora import graph_queries, queries

DATA = Path("/root/testdata/sf0.001")
QUERIES = queries.QUERIES | graph_queries.QUERIES
SQL = queries.SQL | graph_queries.SQL
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 8) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {picked} FROM ({SQL[name]})").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_approximate_search_finds_the_neighbours(spark):
    exact = {(r["query"], r["vec_id"]) for r in QUERIES["cosine_search"](spark, str(DATA)).collect()}
    rows = [(r["query"], r["vec_id"]) for r in QUERIES["approximate_search"](spark, str(DATA)).collect()]
    assert len(rows) == len(set(rows)) == len(exact)
    assert len(exact & set(rows)) >= 0.9 * len(exact)
