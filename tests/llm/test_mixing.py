import numpy as np
import pytest

from pandect.llm import mixing as M
from tests.conftest import rows

DOC = "doc_id bigint, text string, source string, tokens string"
MIX = "mix_id int, source string, weight double, max_repeats int"
WORDS = {"a": "alpha apple arch", "b": "beta bell bolt", "c": "gamma gate gold"}


@pytest.fixture
def docs(spark):
    data = [(i, WORDS[s] * (i % 3 + 1), s.upper() + " " if i % 5 == 0 else s, "clash") for i, s in enumerate("aaaabbbccc" * 30)]
    data += [(1000 + i, WORDS["a"] + " arch", None, None) for i in range(20)] + [(2000, None, "a", None), (None, "x", "a", None)]
    return spark.createDataFrame(data, DOC)


def test_targets(spark):
    t = spark.createDataFrame([(1, "A ", 3.0, 2), (1, "A ", 3.0, 2), (1, "b", 1.0, None), (1, "c", 0.0, 1), (1, None, 5.0, 1), (2, "b", None, 1), (None, "b", 1.0, 1), (1, "a", 1.0, 4)], MIX)
    assert rows(M.targets_of(t)) == [(1, "a", 4.0, 4, 0.8), (1, "b", 1.0, 1, 0.2)]


def test_posteriors_follow_text_and_labels(spark, docs):
    domains = ["a", "b", "c"]
    model = M.Classifier(docs, domains)
    assert model.scale > 0 and all(n == right for n, right in model.held_out.values())
    soft = M.posteriors(docs, model).collect()
    by = {r["doc_id"]: r for r in soft}
    assert all(abs(sum(r["posterior"]) - M.GRAIN) <= 2 for r in soft)
    assert np.argmax(by[1000]["posterior"]) == 0 and by[1000]["label"] is None
    assert all(r["posterior"][domains.index(r["label"])] > M.GRAIN / 2 for r in soft if r["label"])
    assert rows(M.heldout(docs).selectExpr("sum(documents) = sum(named_right)")) == [(True,)]


def test_texts_that_tell_nothing_are_not_asked(spark):
    data = [(i, "same words for all", "ab"[i % 2]) for i in range(200)] + [(999, "same words", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    model = M.Classifier(df, ["a", "b"])
    assert model.scale == 0
    by = {r["doc_id"]: list(r["posterior"]) for r in M.posteriors(df, model).collect()}
    assert by[0] == [M.GRAIN, 0] and by[1] == [0, M.GRAIN] and by[999] == [M.GRAIN // 2, M.GRAIN // 2]


def test_shares_reach_feasible_targets(spark, docs):
    mix = spark.createDataFrame([(1, "a", 1.0, 3), (1, "b", 1.0, 3), (1, "c", 2.0, 6)], MIX)
    got = {r["source"]: r for r in M.shares(docs, mix).collect()}
    for s, want in (("a", 0.25), ("b", 0.25), ("c", 0.5)):
        assert abs(got[s]["reached_share"] - want) < 0.01
    assert all(r["within_repeats"] and r["reached"] for r in M.verified(docs, mix).collect())
    copies = M.chosen(docs, mix)
    caps = {"a": 3, "b": 3, "c": 6}
    assert all(r["copies"] <= caps[r["source"]] for r in copies.collect())


def test_shortfall(spark, docs):
    mix = spark.createDataFrame([(1, "a", 1.0, 1), (1, "nowhere", 1.0, 9), (2, "b", 9.0, 1), (2, "c", 1.0, 4), (3, "a", 0.0, 1)], MIX)
    assert rows(M.found(docs, mix)) == [(1, "a"), (1, "nowhere"), (2, "b")]


def test_empty_tables(spark, docs):
    mix = spark.createDataFrame([(1, "a", 1.0, 1)], MIX)
    assert M.found(docs.limit(0), mix).count() == 0
    assert M.shares(docs.limit(0), mix).count() == 1
    for f in (M.found, M.shares, M.chosen, M.verified):
        assert f(docs, mix.limit(0)).count() == 0
    assert M.heldout(docs.limit(0)).count() == 0


def test_shortfall_needs_the_fit(spark, docs, monkeypatch):
    mix = spark.createDataFrame([(1, "a", 1.0, 1), (1, "nowhere", 1.0, 9)], MIX)
    monkeypatch.setattr(M, "rates", lambda p, cap, capacity, residuals: 0.5 * cap)
    assert rows(M.found(docs, mix)) == [(1, "nowhere")]  # documents below their cap are no sign of a shortfall


def test_rates_converge_to_the_projection():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3] * 3, 400)
    tokens = rng.integers(1, 50, 400).astype(float)
    cap = np.full(400, 3.0)
    capacity = tokens @ p
    goal = capacity * np.array([0.5, 1.5, 1.0])
    residuals = np.zeros((0, 3))
    for _ in range(40):
        r = M.rates(p, cap, capacity, residuals)
        residuals = np.concatenate([residuals, ((r * tokens) @ p - goal)[None]])
    assert np.abs(residuals[-1]).max() < 0.01 * goal.max() and (r >= 0).all() and (r <= 3).all()
