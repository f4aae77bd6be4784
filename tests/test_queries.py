"""Every registered query against its SQL, run by DuckDB on the same files."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = Path("/root/testdata/sf0.001")
QUERIES = entry_point.queries()
ORACLES = {k: v for k, v in entry_point.oracle_sql().items()}
# numbered operators and the pipeline have tests of their own beside their package
QUERIES = {k: v for k, v in QUERIES.items() if not k.startswith("op") and k != "pipeline"}
ORACLES = {k: v for k, v in ORACLES.items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


NO_SQL: set[str] = set()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) <= NO_SQL


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    got = [tuple(map(plain, row)) for row in df.select(columns).collect()]
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
