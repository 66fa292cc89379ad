"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import math
import os

import pytest

from tidewarp import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("orders", "events", "lineitem", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def tidy(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, int | float):
        return f"{float(value) + 0.0:.6g}"
    return str(value)


def table(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(tidy, r)) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(queries.ORACLES[name]).df()
    assert table(mine) == table(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_gives_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and df.columns
    for r in rows:
        assert not any(isinstance(v, float) and math.isinf(v) for v in r)
