"""Every catalogue query that has SQL gives the SQL's rows; the others run and give rows."""

import os

import duckdb
import pandas as pd
import pytest

from pulsegrid.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "fi" or df[c].dtype == object and df[c].map(lambda x: isinstance(x, int | float | None.__class__)).all():
            df[c] = pd.to_numeric(df[c]).astype(float).round(3)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    mine = comparable(catalogue.queries()[name](spark, SF).toPandas())
    theirs = comparable(duck.sql(catalogue.oracle_sql()[name]).df())
    assert len(mine) == len(theirs) > 0
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False, atol=0.0011)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
