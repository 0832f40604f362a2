"""Each query gives what its SQL gives; those without SQL run."""

import pytest

from tests.conftest import DATA
from tidemark import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(name, spark):
    df = catalog.queries()[name](spark, DATA)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
