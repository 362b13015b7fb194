import pytest
from check_oracle import differences

from eventledger.plans import catalog, oracle

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, name, QUERIES[name], SQL[name]) is None
