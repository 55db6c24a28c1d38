"""The queries that SQL can express, against their SQL."""

import os

import duckdb
import pytest

from tarnlake.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    own, other = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.SQL[name]).df()
    key = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))
    assert sorted(own.columns) == sorted(other.columns) and key(own) == key(other)
