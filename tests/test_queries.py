from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"gbt_abstention", "gbt_importance"}  # fits of 100 trees; see test_abstention_query


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        return "null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - SLOW))
def test_query_against_its_sql(spark, sf, duck, name):
    got = library.QUERIES[name](spark, sf).toPandas()
    if name in library.ORACLE_SQL:
        want = duck.execute(library.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
        assert len(got)
    else:
        assert len(got)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(library.QUERIES) <= set(entry.queries())
