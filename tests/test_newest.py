"""The newest row of a key, and tables that are stored."""

import datetime as dt
import os

from pandect.plans.newest import newest
from tests.conftest import rows


def test_newest_row(spark):
    t = lambda n: dt.datetime(2022, 1, n)
    data = [("a", "old", t(1), t(1)), ("a", "late", t(2), t(9)), ("a", "first", t(2), t(3)), ("a", "no time", t(2), None), ("a", "never", None, t(1)), (None, "x", t(9), t(9)), ("b", "only", t(1), None)]
    df = spark.createDataFrame(data, "k string, v string, updated_at timestamp_ntz, synced_at timestamp_ntz")
    assert rows(newest(df, "k", ["v"]).select("k", "v")) == [("a", "first"), ("b", "only")]
    assert newest(df.limit(0), "k", ["v"]).count() == 0
    twice = newest(df.union(df), "k", ["v"])
    assert twice.count() == 2


def test_stored_tables_are_released(spark):
    from pandect.plans.cut import release, stored

    df = stored(spark.range(3))
    place = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 3 and os.path.isdir(place)
    assert release(spark) >= 1 and not os.path.exists(place)
    assert release(spark) == 0
