"""Every query with oracle SQL gives DuckDB's rows on the smallest tables, or on those that ORACLE_SF names (sf0.01)."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry
from tests.conftest import DATA as SMALLEST

DATA = f"{os.path.dirname(SMALLEST)}/{os.environ.get('ORACLE_SF', os.path.basename(SMALLEST))}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df):
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if hasattr(x, "isoformat"):
            return str(pd.Timestamp(x))
        if isinstance(x, str):
            return x
        return round(float(x), 6)
    out = [tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
