"""Every query with SQL against DuckDB on the small tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from tidewater import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def flat(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda v: "null" if v is None or (not isinstance(v, (list, dict, str)) and pd.isna(v)) else str(int(v)) if isinstance(v, float) and v == int(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    if sql := registry.oracle_sql().get(name):
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert flat(got) == flat(want)
    else:
        assert len(got.columns)


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
