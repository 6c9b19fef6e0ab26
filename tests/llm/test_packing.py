import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pandect.llm import packing as P
from tests.conftest import rows


def naive(sizes, capacity):
    """Levels chosen by computing the sum of squares for every choice."""
    counts = [0] * (capacity + 1)
    out = []
    for s in sizes:
        s = s % capacity or (capacity if s else 0)
        if s == 0:
            continue
        best = None
        for level in range(capacity - s + 1):
            if level and not counts[level]:
                continue
            c = counts[:]
            if level:
                c[level] -= 1
            if level + s < capacity:
                c[level + s] += 1
            score = (sum(x * x for x in c[1:capacity]), -level)
            if best is None or score < best[0]:
                best = (score, level, c)
        counts = best[2]
        out.append(best[1])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 25), max_size=40), st.integers(2, 9))
def test_levels_minimise_the_sum_of_squares(sizes, capacity):
    placed = P.pack(np.asarray(sizes, np.int64), capacity)
    tails = {}
    for item, part, tokens, _, _, offset in placed:
        if tokens:
            tails[item] = max(tails.get(item, (0, 0)), (part, offset))
    assert [tails[i][1] for i in sorted(tails)] == naive(sizes, capacity)
    used: dict[int, int] = {}
    for _, _, tokens, container, _, offset in placed:
        if tokens:
            assert used.get(container, 0) == offset
            used[container] = offset + tokens
    assert all(u <= capacity for u in used.values())
    assert [sum(p[2] for p in placed if p[0] == i) for i in range(len(sizes))] == sizes
    assert len({(p[3], p[4]) for p in placed}) == len(placed)


def test_documents(spark):
    data = [(1, "a " * 513, "x"), (2, None, None), (3, "", "y"), (4, "b " * 512, "z"), (5, "c, d!", "z"), (6, "e " * 1025, "z"), (None, "f", "z"), (7, "e " * 1025, "z")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, shard string")
    assert rows(P.found(docs)) == [(1,), (6,), (7,)]
    got = P.packed(docs).groupBy("doc_id").sum("tokens")
    assert rows(got) == [(1, 513), (2, 0), (3, 0), (4, 512), (5, 4), (6, 1025), (7, 1025)]
    assert P.packed(docs.limit(0)).count() == 0 and P.fill_report(docs.limit(0)).count() == 0


def test_shards_have_their_own_containers(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('a ', cast(id % 90 + 1 as int)) as text")
    one, many = (P.packed(docs, 128, n) for n in (1000, 50))
    for p in (one, many):
        assert p.groupBy("container_id").sum("tokens").where("`sum(tokens)` > 128").count() == 0
        assert p.select("doc_id").distinct().count() == 500
    assert many.selectExpr("shiftright(container_id, 32) as s").distinct().count() == 10
