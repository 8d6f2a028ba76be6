"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from docketry.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows(df):
    df = df[sorted(df.columns)]
    none = lambda v: v is None or (pd.api.types.is_scalar(v) and pd.isna(v))
    show = lambda v: "none" if none(v) else f"{float(v):.6g}" if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).df())
