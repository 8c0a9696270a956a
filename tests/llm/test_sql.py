import pytest

from sondage.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])
