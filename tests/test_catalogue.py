import pytest
from oracle import assert_same

from evidentia.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_duckdb(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), SQL[name], sf)


def test_entry_has_all_queries(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
