"""Every query of the page engine against its SQL on the smallest tables."""

import duckdb
import pytest

from pageforge.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) - {"clean_pages"} == set(ORACLES)  # tests/test_pages.py holds the whole way


def test_whole_way(spark):
    found = QUERIES["clean_pages"](spark, SF).toPandas()
    assert len(found) == 500 and found["flags"].str.contains("low_resolution").all() and found["confidence"].between(0, 0.85).all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())
