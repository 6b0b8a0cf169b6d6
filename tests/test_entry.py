import duckdb
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from weftline import plans

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def rows(df):
    show = lambda x: "null" if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(show(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_against_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    wanted = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
