import importlib
import os
import sys

import duckdb
import pytest
from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

from sparkloom.queries import QUERIES, SQL  # noqa: E402

NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in compare.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, con, name):
    df, res = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert compare.rows(df.collect(), df.columns) == compare.rows(res.fetchall(), res.columns)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
