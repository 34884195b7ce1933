import os

import pytest

from oracle import SF, assert_same, connect
from tidewell.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(), SQL[name])
