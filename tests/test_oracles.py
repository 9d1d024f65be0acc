import glob
import os

import duckdb
import pytest

from textmill.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if v != v else round(float(v), 9)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    ours = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(normal(r[sql.columns.index(c)]) for c in cols) for r in sql.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
