"""Every query with SQL gives the rows that DuckDB gives for it."""

import datetime
import decimal
import os

import duckdb
import pytest

from quirelight.plans import all_queries

QUERIES, SQL = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return None if x != x else round(float(x), 9)
    return x.isoformat() if isinstance(x, (datetime.datetime, datetime.date)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    mine = QUERIES[name](spark, sf)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(mine.columns)
    order = sorted(names)
    theirs = sorted((repr([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall()))
    assert sorted(repr([plain(r[c]) for c in order]) for r in mine.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1
