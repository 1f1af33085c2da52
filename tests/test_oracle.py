"""Every query with SQL gives what DuckDB gives on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessella.plans.catalog import ORACLE, QUERIES

DIR = os.environ.get("TESSELLA_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = canon(QUERIES[name](spark, DIR).toPandas())
    want = canon(duck.execute(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0 or name == "symmetry_check"
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert (abs(got[c] - want[c]) <= 1e-5 + 1e-7 * abs(want[c])).all(), c
        else:
            assert got[c].dtype == want[c].dtype and (got[c] == want[c]).all(), c
