"""Registered queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from netweave.plans import catalog

DATA = os.environ.get("NETWEAVE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def rows(df, columns):
    return sorted((tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in df[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 1
