import pytest

from fleetops import plans
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_others_give_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(1).count() == 1
