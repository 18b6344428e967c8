"""Every registered query of the questionnaire engine against its SQL in DuckDB, on the smallest tables."""

import decimal

import pytest

from tallyforge.plans import queries as plan_queries
from tallyforge.plans.fixtures import TABLES
from tallyforge.plans.oracles import oracle_sql
from tallyforge.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def shared(spark):
    """One set of views for all queries, so that what several of them write is written once."""
    views = plan_queries.Views(spark, FOLDER)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plan_queries, "Views", lambda *_: views)
        yield views


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, shared, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    rows = [tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=repr)


def test_every_query_is_registered_once():
    assert set(SQL) <= set(QUERIES)
