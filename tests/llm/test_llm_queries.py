import glob
import os

import duckdb
import pandas as pd
import pytest

from tessera.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = registry.queries()[name](spark, SF).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    k = sorted(a.columns)
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)
