"""Every query with SQL gives the same rows as DuckDB on the smallest tables; every query runs twice to the same rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tracewright.plans import catalogue


def _value(x):
    if x is None:
        return None
    if hasattr(x, "tolist") and not isinstance(x, (bytes, str)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(_value(y) for y in x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, pd.Timestamp):
        return None if pd.isna(x) else str(x.tz_localize(None) if x.tzinfo else x)
    return float(x) if x.__class__.__name__ == "Decimal" else x


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted([tuple(_value(x) for x in r) for r in df.itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {"svm_scores", "gbt_scores"}))
def test_runs(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 1 and got[0].docs > 0


def test_names_are_unique_and_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
