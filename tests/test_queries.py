"""Every registered query at the smallest scale: against its oracle, or not empty.

The document queries have their own tests.
"""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in queries() if not re.match(r"op\d+_|pipeline$", n)])
def test_query(spark, duck, name):
    frame = queries()[name](spark, FOLDER).toPandas()
    if name in oracle_sql():
        assert compare(frame, duck.sql(oracle_sql()[name]).df()) == ""
    else:
        assert len(frame) > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
