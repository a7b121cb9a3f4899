"""Every registered query against its SQL on the smallest tables."""
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    plain = [[None if pd.api.types.is_scalar(x) and pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r]
             for r in df.astype(object).itertuples(index=False)]
    return sorted(plain, key=str)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert {r["subset"] for r in entry_module.entry(spark).collect()} == {"train", "val"}
