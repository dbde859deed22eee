from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from trawlspark.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


def value(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    r = con.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted((tuple(map(value, x)) for x in df.select(*cols).collect()), key=repr)
    assert got == sorted((tuple(map(value, x)) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
