import pytest
from oracle import check

from loamcast import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    check(df, catalog.ORACLES[name], sf)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
