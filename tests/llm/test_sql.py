"""Queries that SQL can express against DuckDB, on whole tables."""

import duckdb
import pytest

from mediaquarry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = duck.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want) and len(got)
