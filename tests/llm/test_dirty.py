import pytest

from pandect.llm import queries
from tests.dirty import check, write_dirty


@pytest.fixture(scope="module", params=[False, True], ids=["dirty", "empty"])
def folder(request, spark, tmp_path_factory):
    return write_dirty(spark, str(tmp_path_factory.mktemp("dirty")), ["lat", "documents", "mix_targets"], request.param), request.param


@pytest.mark.parametrize("n", [5, 6, 7, 8])
def test_found(spark, folder, n):
    check(queries.QUERIES[f"p{n}_found"](spark, folder[0]), folder[1])


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if not q.endswith("_found")])
def test_other_queries_run(spark, folder, name):
    assert queries.QUERIES[name](spark, folder[0]).count() >= 0
