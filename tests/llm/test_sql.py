"""Queries that have SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from support import SMALL, database, spark_rows, sql_rows

from corvane.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SMALL)) == sql_rows(database(SMALL), queries.ORACLE_SQL[name])
