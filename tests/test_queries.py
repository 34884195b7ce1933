import os

import pytest

import __spark_entry__
from oracle import SF, assert_same, connect
from tidewell.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


def test_contract(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["step", "entities"]
