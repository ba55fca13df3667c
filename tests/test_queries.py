"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from linkloom.plans import oracles, record_queries
from linkloom.plans import queries as matching

QUERIES = matching.QUERIES | record_queries.QUERIES
ORACLES = oracles.ORACLES | record_queries.ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def normal(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb":
            df[c] = df[c].astype(float).round(5)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
