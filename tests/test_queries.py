"""Every query with SQL, against DuckDB on the small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from eventloom.plans import catalog as registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, np.floating)) else v
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.SQL:
        want = con.sql(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
