import pytest
from oracle import connect, differences

from groundwork import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name]) == []


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
