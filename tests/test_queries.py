"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from gneiss.queries import QUERIES, SQL
from gneiss.sources.catalog import TESTDATA

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TESTDATA:
        c.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        return None if not isinstance(v, list) and pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
