"""Every query with SQL gives the SQL's rows; the others give rows."""

from __future__ import annotations

import pytest
from support import SMALL, database, spark_rows, sql_rows

import __spark_entry__ as entry
from corvane import queries as library


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, con, name):
    got = spark_rows(library.QUERIES[name](spark, SMALL))
    if name in library.ORACLE_SQL:
        assert got == sql_rows(con, library.ORACLE_SQL[name])
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(library.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
