"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from docweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        if isinstance(v, float):
            return str(round(v, 6) + 0.0)
        return str(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, small, duck, name):
    ours = registry.QUERIES[name](spark, small).toPandas()
    theirs = duck.sql(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
