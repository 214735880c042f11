"""All registered queries against their reference SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", driver.queries())
def test_query(spark, sf_dir, duck, name):
    got = driver.queries()[name](spark, sf_dir).toPandas()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = ordered(duck.execute(sql).df())
    got = ordered(got)
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for column in got.columns:
        same = (got[column] == want[column]) | (got[column].isna() & want[column].isna())
        assert same.all(), column


def test_entry(spark):
    assert driver.entry(spark).agg({"hits": "sum"}).first()[0] == 742
