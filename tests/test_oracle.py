"""Every registered query with an SQL twin against DuckDB, on whole tables of the smallest size."""

import os

import pytest

import oracle
from sourcemart.checks import REGISTRY

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("key", list(REGISTRY))
def test_query(spark, con, key):
    entry = REGISTRY[key]
    frame = entry.run(spark, FOLDER)
    if entry.sql:
        found = oracle.compare(con, frame, entry.sql)
        if found == "EMPTY":  # a filter that finds nothing in the smallest tables is held against larger ones
            found = oracle.compare(oracle.connect(LARGER), entry.run(spark, LARGER), entry.sql)
        assert found is None
    else:
        assert frame.count() > 0
