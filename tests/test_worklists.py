"""Lists of work: merges with transitions, summaries, and their edge cases."""

from pyspark.sql import functions as F

from pandect.operators import worklists as W
from tests.conftest import rows

ENTRY = "session_id string, affected_law string, update_type string, status string, layer int, source_laws array<string>"


def entries(spark, data=None):
    made = [("s", "A", "reparse", "pending", 2, ["x", "y"]), ("s", "B", "reparse", "processed", 1, ["x"]), ("s", "C", "link", "pending", None, None), ("t", "A", "link", "processed", 1, [])]
    return spark.createDataFrame(made if data is None else data, ENTRY)


def test_transitions(spark):
    state = spark.createDataFrame([("a", "pending"), ("b", "parsed"), ("c", "confirmed"), ("d", None)], "k string, status string")
    updates = spark.createDataFrame([("a", "parsed", 1), ("a", "confirmed", 0), ("b", "skipped", 1), ("new", "pending", 1), (None, "pending", 1), ("d", "parsed", 1), ("c", None, 1)], "k string, status string, n int")
    allowed = {"pending": ("parsed",), "parsed": ("confirmed",)}
    after, refused = W.transitions(state, updates, ["k"], allowed, "n")
    assert rows(after) == [("a", "parsed"), ("b", "parsed"), ("c", "confirmed"), ("d", "parsed"), ("new", "pending")]
    assert rows(refused) == [("b", "parsed", "skipped")]
    again, none = W.transitions(after, updates.limit(0), ["k"], allowed, "n")
    assert rows(again) == rows(after) and none.count() == 0


def test_cascades(spark):
    e = entries(spark)
    assert rows(W.layered(e).where("session_id = 's'").select("place", "affected_law")) == [(1, "B"), (2, "A"), (3, "C")]
    assert rows(W.cascade_summary(e, ["pending", "processed"])) == [("s", 1, 2, 2, 1, 2), ("t", 1, 1, 0, 1, 0)]
    sessions = spark.createDataFrame([("s",), ("t",), ("u",)], "session_id string")
    assert rows(W.session_stats(sessions, e, ["reparse", "link"])) == [("s", 3, 2, 1, 2), ("t", 1, 0, 1, 0), ("u", 0, 0, 0, 0)]
    assert rows(W.sessions_with_pending(e)) == [("s", 2)]
    assert W.cascade_summary(entries(spark, []), ["pending"]).count() == 0 and W.layered(entries(spark, [])).count() == 0
    marked = W.mark(e, F.col("layer") == 2, "done")
    assert [r["affected_law"] for r in marked.where("status = 'done'").collect()] == ["A"]


def test_lists_and_sources(spark):
    s = spark.createDataFrame([("s", ["A", "A", ""], None), ("t", [None], ["B"])], "session_id string, a array<string>, b array<string>")
    assert rows(W.entries_of_lists(s, {"a": "reparse", "b": "link"})) == [("s", "reparse", "A"), ("t", "link", "B")]
    table, landed = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert rows(W.with_source(table, landed, ["k"])) == [("x", 1, "table"), ("y", 3, "file")]


def test_fields(spark):
    df = spark.createDataFrame([("a", None, " "), ("b", "B", "t"), (None, "C", None)], "name string, Title string, title_en string")
    assert rows(W.renamed(df, {"n": ["Name", "name"], "t": ["Title", "title_en"]})) == [("a", " "), ("b", "B"), (None, "C")]
    meta = df.select("name", F.lit("meta").alias("title_en"), F.lit(1).alias("x"))
    assert rows(W.enriched(df.select("name", "title_en"), meta, "name", "title_en", ["x"]).where("name is not null")) == [("a", "meta", 1), ("b", "t", 1)]
    yes, no = W.split_on(df, F.col("Title") == "B")
    assert yes.count() == 1 and no.count() == 2
    assert rows(df.select(W.array_of(F.col("title_en")), W.text_of(F.array("name", "Title")))) == sorted([([" "], "a"), (["t"], "b,B"), (None, "C")], key=repr)
    assert rows(df.select(W.domain_of(F.col("name"), {"a": "first"}))) == [("first",), (None,), (None,)]
    assert rows(W.results_per_item(df.select("name"), F.when(F.col("name") == "a", 1), "none")) == [("a", 1, None), ("b", None, "none"), (None, None, "none")]


def test_scopes_answers_and_days(spark):
    df = spark.createDataFrame([("t1", 1, "2020-01-01"), ("t2", 2, "2020-01-03"), (None, 3, None)], "tenant string, v int, d string").withColumn("d", F.to_date("d"))
    assert rows(W.scoped(df, "t1", "tenant", F.col("v") > 0).select("v")) == [(1,)]
    assert W.scoped(df, "t1", "tenant", F.col("v") > 1).count() == 0
    assert rows(W.days("2020-01-02", "2020-01-05", df, "d").select("v")) == [(2,)]
    assert rows(W.answer({"x": df.select("tenant", "v")}, "x/t2", {"x": "tenant"})) == [("t2", '{"tenant":"t2","v":2}')]
    assert rows(W.compared(df.where("v < 3").select("tenant", "v"), df.where("v > 1").select("tenant", "v"), "tenant", "v")) == sorted([("t1", 1, None, None), ("t2", 2, 2, 0.0), (None, None, 3, None)], key=repr)
    assert rows(W.replaced(df.select("tenant", "v"), spark.createDataFrame([("t1", 9)], "tenant string, v int"), "tenant", "t1")) == sorted([("t1", 9), ("t2", 2), (None, 3)], key=repr)
