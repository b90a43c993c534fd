"""Every registered query against its SQL in DuckDB."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from stackloom import suite


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(suite.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = suite.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(suite.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert mine == theirs


def test_queries_without_sql_have_rows(spark, sf_dir):
    for name in sorted(suite.QUERIES.keys() - suite.ORACLE_SQL.keys()):
        assert suite.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
