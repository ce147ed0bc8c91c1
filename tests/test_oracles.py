"""Every registered graph query against its SQL form."""

import os

import duckdb
import pytest
from conftest import DATA

from sparkloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(df):
    return sorted(tuple("%.6g" % x if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert norm(a) == norm(b)
