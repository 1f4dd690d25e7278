"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import decimal

import duckdb
import pandas as pd
import pytest

from mediaquarry.plans import containers, faces, library, more, people, upkeep  # noqa: F401
from mediaquarry.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings pages conversations".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (float, decimal.Decimal)):
        return None if value != value else round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert "position" in df.columns and df.count() > 0
