"""Queries that SQL can express, against it."""

import pytest

from tidemark.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(queries.queries()[name], SQL[name])
