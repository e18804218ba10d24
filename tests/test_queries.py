"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from shelfrank.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype.kind in "fiu" or str(df[c].dtype).startswith("Int"):
            df[c] = df[c].astype("float64").round(6) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    spark.catalog.clearCache()
    if name not in registry.ORACLES:
        assert len(got)
        return
    pd.testing.assert_frame_equal(canonical(got), canonical(duck.sql(registry.ORACLES[name]).df()), check_dtype=False)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
