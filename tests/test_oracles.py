import pytest

import __spark_entry__ as entry
from larkfold.plans import registry
from tests.compare import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == duck_rows(con, registry.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
