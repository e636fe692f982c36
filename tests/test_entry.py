"""Every registered query against its oracle, on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry_file
from buyerscope.sources.wide import TABLES

QUERIES, ORACLES = entry_file.queries(), entry_file.oracle_sql()
# Slow model queries run in test_models and test_jobs already.
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return str(v) if isinstance(v, (dt.date, dt.datetime)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0) for x in r))


def test_oracles_belong_to_queries():
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert ordered(got) == ordered(want)


def test_flagship(spark):
    assert entry_file.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["lr", "importance", "feat_scaled", "score_batch"])
def test_model_queries_run(spark, folder, name):
    assert name in ROWS_ONLY
    assert QUERIES[name](spark, folder).count() > 0
