"""Every query runs; those with SQL give the SQL's rows."""

import pytest

from pandect.queries import edges, keys, legacy, matching, problems, register, sources, streams, text, worklists
from tests.conftest import SMALL
from tests.oracle import both

MODULES = [problems, register, keys, edges, matching, text, legacy, sources, streams, worklists]
QUERIES = {n: (q, m.ORACLE.get(n)) for m in MODULES for n, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    query, sql = QUERIES[name]
    if sql is None:
        query(spark, SMALL).count()
        return
    got, want = both(spark, query, sql)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
