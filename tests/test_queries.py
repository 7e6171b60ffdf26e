"""Each query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas
import pytest

import __spark_entry__ as entry
from mosswork.plans.all_queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def shown(frame):
    cell = lambda v: None if v is None or pandas.isna(v) else round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else v
    return sorted(repr(tuple(cell(v) for v in row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    got, expected = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = shown(got), shown(expected)
    assert len(a) == len(b) and [x.replace(".0,", ",").replace(".0)", ")") for x in a] == [x.replace(".0,", ",").replace(".0)", ")") for x in b]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
