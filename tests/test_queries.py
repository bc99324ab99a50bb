"""Every query with SQL of its own against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera.plans import driver_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    k = sorted(a.columns)
    assert k == sorted(b.columns)
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", sorted(driver_queries.SQL))
def test_equals_sql(spark, db, name):
    same(driver_queries.QUERIES[name](spark, SF).toPandas(), db.sql(driver_queries.SQL[name]).df())


def test_heading_paths(spark):
    """Over a table now; the literals it had are in test_parsing."""
    rows = driver_queries.heading_paths(spark, SF).orderBy("doc_id", "i").collect()
    assert [r["heading_path"] for r in rows if r["doc_id"] == 2][:4] == ["", "src2", "src2 > in quote 2", "src2 > in quote 2 > in item"]


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
