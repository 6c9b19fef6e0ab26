import pytest

from pandect.llm import queries
from tests.conftest import SMALL
from tests.oracle import both


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    query, sql = queries.QUERIES[name], queries.ORACLE.get(name)
    if sql is None:
        query(spark, SMALL).count()
        return
    got, want = both(spark, query, sql)
    assert got == want
