"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import check
from workload.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = [tuple(row) for row in frame.collect()]
    assert rows
    if name in ORACLES:
        expected = tables.sql(ORACLES[name])
        assert sorted(frame.columns) == sorted(expected.columns)
        assert check.digest(frame.columns, rows) == check.digest(
            expected.columns, expected.fetchall())
