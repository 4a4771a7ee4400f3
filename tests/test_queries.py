"""Every registered query against its SQL on the smallest tables, and the reports' path end to end."""

import math

import duckdb
import pytest

from assayframe import more_queries, oracles
from assayframe.queries import QUERIES

ORACLES = oracles.ORACLES | more_queries.ORACLES
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        out = duck.execute(ORACLES[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == cols
        assert got == sorted(([plain(r[names.index(c)]) for c in cols] for r in out.fetchall()), key=str)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
