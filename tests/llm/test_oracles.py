"""The exact joins against DuckDB over whole tables."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(map(tuple, c.sql(queries.ORACLES[name]).df().sort_index(axis=1).itertuples(index=False)))
    got = sorted(map(tuple, queries.queries()[name](spark, SF).toPandas().sort_index(axis=1).itertuples(index=False)))
    assert got == want and len(got) > 0
