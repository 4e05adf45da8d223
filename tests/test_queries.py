"""Every registered query of the service against its DuckDB SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from gazette.plans import registry
from gazette.sources.entities import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(frame):
    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(registry.ORACLES[name]).fetch_df()
    assert len(got)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_feed_plan(spark):
    """The hidden notices are an anti-join, nothing is a product, and only the columns needed are read."""
    plan = registry.QUERIES["user_feed"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan
    assert "CartesianProduct" not in plan
    assert "o_totalprice" not in plan
