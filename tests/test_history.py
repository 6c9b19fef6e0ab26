"""Merkle comparison, versions, and statuses of laws."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pandect.operators import law_status
from pandect.operators.merkle_history import append_versions, changed_leaves, diff_snapshots, leaf_of, maintain, versions
from tests.conftest import rows

T = "k string, v string, w int"


def test_diff_finds_each_kind_of_change(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", None), ("c", None, 3), ("d", "4", 4), (None, "x", 0)], T)
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 9), ("c", None, 3), ("e", None, None), ("e", None, None)], T)
    assert rows(diff_snapshots(old, new, ["k"], ["v", "w"])) == [("b", "2", 9, "update"), ("d", None, None, "delete"), ("e", None, None, "insert")]


def test_only_differing_leaves_are_descended(spark):
    base = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
    other = base.withColumn("v", F.when(F.col("k") == "17", "y").otherwise(F.col("v")))
    leaves = rows(changed_leaves(base, other, ["k"], ["v"]))
    want = base.where("k = '17'").select(leaf_of(["k"])).first()[0]
    assert leaves == [(want,)]
    assert rows(changed_leaves(base, base, ["k"], ["v"])) == []


def test_null_and_value_are_told_apart(spark):
    a = spark.createDataFrame([("k", None, 1)], T)
    b = spark.createDataFrame([("k", "1", None)], T)
    assert len(rows(diff_snapshots(a, b, ["k"], ["v", "w"]))) == 1


def test_empty_snapshots(spark):
    empty, one = spark.createDataFrame([], T), spark.createDataFrame([("a", "1", 1)], T)
    assert rows(diff_snapshots(empty, empty, ["k"], ["v"])) == []
    assert rows(diff_snapshots(empty, one, ["k"], ["v"])) == [("a", "1", "insert")]
    assert rows(diff_snapshots(one, empty, ["k"], ["v"])) == [("a", None, "delete")]


def test_append_versions_closes_and_opens(spark):
    history = spark.createDataFrame([("a", "1", 1, 0, None), ("b", "1", 1, 0, None)], f"{T}, valid_from int, valid_to int")
    changes = spark.createDataFrame([("a", "2", 1, "update"), ("b", None, None, "delete"), ("c", "9", 9, "insert")], f"{T}, change string")
    got = rows(append_versions(history, changes, ["k"], ["v", "w"], F.lit(5)))
    assert got == [("a", "1", 1, 0, 5), ("a", "2", 1, 5, None), ("b", "1", 1, 0, 5), ("c", "9", 9, 5, None)]


def test_history_after_a_chain_of_snapshots(spark):
    t = "k string, t bigint, v string"
    first = [(f"k{i}", 10, "x") for i in range(50)]
    second = [*first, ("k1", 20, "y"), ("k2", 5, "y"), ("new", 1, "x")]
    third = [r for r in second if r[0] != "k3"] + [("k1", 15, "y"), ("k1", 30, "x")]
    for chain in ([third], [first, second, third], [first, *[second] * 9, third], [[], third]):
        kept = maintain([spark.createDataFrame(x, t) for x in chain], ["k"], "t", "v", 7)
        want = rows(versions(spark.createDataFrame(third, t), ["k"], "t", "v", 7))
        assert rows(kept.history) == want
    assert ("k1", "y", 15, 30) in want and ("k2", "y", 5, 10) in want and not any(r[0] == "k3" for r in want)


def test_only_keys_of_changed_leaves_get_new_versions(spark, monkeypatch):
    from pandect.operators import merkle_history as m

    t = "k string, t bigint, v string"
    first = [(f"k{i}", 10, "x") for i in range(500)]
    seen = []
    make = m.versions
    monkeypatch.setattr(m, "versions", lambda df, *a: (seen.append(df.count()), make(df, *a))[1])
    kept = maintain([spark.createDataFrame(x, t) for x in (first, first + [("k7", 20, "y")])], ["k"], "t", "v", 7)
    assert seen == [500, 2] and kept.history.count() == 501
    other, now = kept.looked_at[0]
    assert other.count() == 3 and now.count() > 500  # root, one node, one leaf


@pytest.mark.parametrize("span", [1, 3, 7, 1000])
def test_versions_do_not_depend_on_stretches(spark, span):
    seen = [("a", t, "xy"[(t // 5) % 2]) for t in range(40)] + [("b", 3, "x"), ("b", 3, "x"), ("b", 38, "x")]
    got = rows(versions(spark.createDataFrame(seen, "k string, t bigint, v string"), ["k"], "t", "v", span))
    want = [("a", "xy"[i % 2], 5 * i, 5 * i + 5 if i < 7 else None) for i in range(8)] + [("b", "x", 3, None)]
    assert got == sorted(want, key=repr)


LAW = "name string, live string, updated_at timestamp_ntz, synced_at timestamp_ntz, record_change_log array<struct<timestamp:string,source:string,changed_by:string,summary:string,changes:map<string,struct<old:string,new:string>>>>, extra string, at int"


def test_statuses_of_laws(spark):
    t = dt.datetime
    log = lambda ts, new: (ts, None, None, None, {"live": (None, new)})
    laws = spark.createDataFrame(
        [
            ("L1", "✔ In force", t(2022, 1, 2), t(2022, 1, 3), [log("2022-01-01T23:30:00-01:00", '"\\u274c Revoked"'), log("unknown", "Revoked"), log(None, "Revoked"), ("2022-01-01", None, None, None, None)], "x", 1),
            ("L1", "in  FORCE", t(2022, 1, 2), t(2022, 1, 4), None, "x", 1),
            ("L1", "?", t(2022, 2, 2), t(2022, 2, 3), [], "x", 1),
            ("L2", None, None, t(2022, 1, 1), [log("2022-03-04 05:06:07.9", "Revoked")], None, None),
            (None, "In force", t(2022, 1, 1), t(2022, 1, 1), None, None, None),
            ("L3", "", t(2022, 1, 1), None, [None], None, None),
        ],
        LAW,
    )
    statuses = spark.createDataFrame([("in_force", "✔ In force"), ("revoked", "❌ Revoked"), (None, "Gone"), ("x", None)], "status_code string, label string")
    # 23:30 at -01:00 is 00:30 of the next day, after midnight of the row's own time.
    assert rows(law_status.found(laws, statuses)) == [("L1", "2022-01-02 00:00:00", "in_force"), ("L1", "2022-01-02 00:30:00", "revoked"), ("L2", "2022-03-04 05:06:07", "revoked")]
    assert law_status.found(laws.limit(0), statuses).count() == 0
    assert law_status.found(laws, statuses.limit(0)).count() == 0
