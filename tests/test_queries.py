"""Every registered query of the library against its SQL on the smallest tables; the others must give rows."""

import pytest

from hazeloom.plans import registry
from tests.helpers import connect, same

ALL = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", ALL)
def test_query(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    if sql := registry.oracle_sql().get(name):
        same(df, con.sql(sql))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
