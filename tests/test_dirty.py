import pytest

from pandect.queries import problems
from tests.dirty import check, write_dirty

TABLES = ["uk_lrt", "lat", "amendment_annotations", "removed_keys", "live_statuses"]


@pytest.fixture(scope="module", params=[False, True], ids=["dirty", "empty"])
def folder(request, spark, tmp_path_factory):
    return write_dirty(spark, str(tmp_path_factory.mktemp("dirty")), TABLES, request.param), request.param


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_found(spark, folder, n):
    check(problems.QUERIES[f"p{n}_found"](spark, folder[0]), folder[1])


@pytest.mark.parametrize("name", [q for q in problems.QUERIES if not q.endswith("_found")])
def test_other_queries_run(spark, folder, name):
    assert problems.QUERIES[name](spark, folder[0]).count() >= 0
