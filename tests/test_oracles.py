"""Every registered query against its DuckDB twin."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(plain(dict(zip(columns, row, strict=True))[c]) for c in sorted(columns)) for row in result.fetchall()), key=repr)
    rows = sorted((tuple(plain(row[c]) for c in sorted(columns)) for row in got.collect()), key=repr)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    if name.startswith("op") or name == "pipeline":
        pytest.skip("tested with its subpackage")
    df = entry.queries()[name](spark, SF)
    assert df.columns
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
