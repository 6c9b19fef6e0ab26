from pyspark.sql import functions as F

from pandect.operators import changes, edges, filters, matching, register, sequences, views
from tests.conftest import rows

S = "k string, a string, m map<string,boolean>"


def states(spark):
    old = spark.createDataFrame([("1", "x", {"p": True, "q": True}), ("2", "", None), ("3", "z", {}), ("4", None, None)], S)
    new = spark.createDataFrame([("1", "y", {"q": False, "r": True}), ("2", "w", {"s": True}), ("3", " ", None), ("5", "n", None)], S)
    return old, new


def flat(df):
    return sorted(((r["k"], r["a"], tuple(sorted((r["m"] or {}).items()))) for r in df.collect()), key=repr)


def test_merge_modes(spark):
    old, new = states(spark)
    assert flat(changes.merged(old, new, ["k"], "overwrite_non_empty")) == [("1", "y", (("p", True), ("q", False), ("r", True))), ("2", "w", (("s", True),)), ("3", "z", ()), ("4", None, ()), ("5", "n", ())]
    assert flat(changes.merged(old, new, ["k"], "fill_missing"))[0] == ("1", "x", (("p", True), ("q", True), ("r", True)))
    assert [r[0] for r in flat(changes.upsert(old, new, ["k"]))] == ["1", "2", "3", "4", "5"]
    assert [r[0] for r in flat(changes.without_keys(old, new, ["k"]))] == ["4"]
    assert flat(changes.merged(old, new.limit(0), ["k"], "fill_missing"))[3][0] == "4"


def test_log_entries(spark):
    df = spark.createDataFrame([("a", "b", None, [1], [1]), ("a", "a", " ", [], None)], "x string, old_x string, old_y string, y array<int>, z array<int>").withColumn("old_y", F.when(F.col("old_y").isNotNull(), F.array().cast("array<int>")))
    c = changes.changed_fields(df, ["x", "y"])
    got = df.select(changes.summary(c).alias("s"), changes.appended(F.lit(None).cast("array<struct<timestamp:string,source:string,changed_by:string,summary:string,changes:map<string,struct<old:string,new:string>>>>"), changes.log_entry(c, F.lit("2022-01-01"), "manual", "me")).alias("l")).collect()
    assert [r["s"] for r in got] == ["Updated 2 fields: x, y", "No changes"]
    assert got[0]["l"][0]["changes"]["x"] == ("b", "a") and got[1]["l"] == []
    logs = spark.createDataFrame([(got[0]["l"],), ([],), (None,)], "l array<struct<timestamp:string,source:string,changed_by:string,summary:string,changes:map<string,struct<old:string,new:string>>>>")
    assert [r[0] for r in logs.select(changes.log_summary(F.col("l"))).collect()] == ["1 update since 2022-01-01", "No change history", "No change history"]


def test_document_forms(spark):
    df = spark.createDataFrame([([("H", "a1"), ("H", None), (None, "a0")],)], "e array<struct<holder:string,article:string>>")
    d = df.select(changes.as_document(F.col("e"), "holder", "holders").alias("d")).first()["d"]
    assert d["holders"] == ["H"] and d["articles"] == ["a0", "a1"] and len(d["entries"]) == 3


def test_cascade_stops_and_keeps_first_layer(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("b", "a"), ("a", "a"), ("x", "c")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "name string")
    got = rows(edges.cascade(e, seeds))
    assert got == [("b", 1, ["a"]), ("c", 1, ["a"]), ("d", 2, ["c"]), ("e", 3, ["d"])]
    assert rows(edges.cascade(e, seeds, 1)) == got[:2]
    assert edges.cascade(e.limit(0), seeds).count() == 0
    long = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(10)], "src string, dst string")
    start = spark.createDataFrame([("n0",)], "name string")
    assert edges.cascade(long, start, None).agg(F.max("layer")).first()[0] == 10
    assert edges.cascade(long.limit(0), start, None).count() == 0


def test_status_of_revocations(spark):
    c = spark.createDataFrame([("L", "M", "words repealed in part"), ("L", "L", "revoked in full"), ("N", "M", "repealed"), ("O", "M", None)], "law_name string, item string, affect string")
    got = {r["law_name"]: (r["status"], r["self_changes"]) for r in edges.change_stats(c).collect()}
    assert got == {"L": (register.PART_REVOKED, 1), "N": (register.REVOKED, 0), "O": (register.IN_FORCE, 0)}


def test_change_lines(spark):
    df = spark.createDataFrame([("s. 1", "repealed", "Yes"), ("s. 1", "", None), (None, "repealed", None), (None, "", "Yes")], "t string, a string, p string")
    assert [r[0] for r in df.select(edges.change_line(F.col("t"), F.col("a"), F.col("p"))).collect()] == ["s. 1 repealed [Yes]", "s. 1", "repealed []", None]


def test_filters():
    assert [filters.clamp(v, 50, 100) for v in (None, "x", -1, "7", 1000)] == [50, 50, 50, 7, 100]
    assert [filters.fraction(v, 0.5) for v in (None, "x", -1, "0.25", 2)] == [0.5, 0.5, 0.5, 0.25, 0.5]
    assert filters.has_more(11, 5, 5) and not filters.has_more(10, 5, 5)


def test_null_predicates(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("", 3)], "a string, n int")
    pick = lambda op, v=None: [r["n"] for r in df.where(filters.OPERATORS[op]("a", v)).collect()]
    assert pick("is_empty") == [2, 3] and pick("is_not_empty") == [1] and pick("not_equals", "y") == [1, 3] and pick("contains", "X") == [1]
    assert df.where(filters.all_of([None, None])).count() == 3


def test_calendar():
    at = views.calendar("2024-01-31")
    assert [str(at[k]) for k in ("last_month", "this_quarter", "last_quarter", "last_3_years")] == ["2023-12-01", "2024-01-01", "2023-10-01", "2021-01-01"]
    assert len(views.VIEWS) == 25


def test_percentiles_at_the_lower_rank(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", None), ("c", 7.0)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"], r["least"], r["greatest"], r["n"]) for r in register.percentile_rank(df, ["k"], "v", [50, 95]).collect()}
    assert got == {"a": (2.0, 3.0, 1.0, 4.0, 4), "c": (7.0, 7.0, 7.0, 7.0, 1)}


def test_ranges_and_repeats(spark):
    df = spark.createDataFrame([("k", 1, 3), ("k", 2, 9), ("k", 9, 10), ("k", 12, 13), ("j", 0, 0)], "k string, a int, b int")
    for span in (None, 1, 3, 100):
        assert rows(sequences.merged_ranges(df, ["k"], "a", "b", span)) == [("j", 0, 0), ("k", 1, 10), ("k", 12, 13)]
    d = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, p int")
    assert [r["unique_key"] for r in sequences.disambiguated(d, "k", "p").orderBy("p").collect()] == ["x#1", "x#2", "y"]


def test_vocabularies(spark):
    df = spark.createDataFrame([("A Kiln and a Sluice",), ("nothing",), (None,)], "t string")
    got = df.select(matching.first_match(F.col("t"), [("W", ["sluice"]), ("F", ["kiln"])]), matching.excluded(F.col("t"), ["^A "]), matching.first_match(F.col("t"), [])).collect()
    assert [tuple(r) for r in got] == [("W", True, None), (None, False, None), (None, False, None)]
    codes = spark.createDataFrame([("water, england and wales; fire ",), (None,)], "c string").select(matching.codes_of(F.col("c")).alias("c"))
    assert [r[0] for r in codes.collect()] == [["FIRE", "WATER"], None]


def test_stretches_change_nothing(spark):
    data = [("hot" if i % 3 else None, None if i == 7 else i * 37 % 101, f"h{i}" if i % 9 == 0 else None) for i in range(150)]
    df = spark.createDataFrame(data, "k string, o int, v string")
    for s in (F.lit(0), F.floor(F.col("o") / 10), F.col("o")):
        assert rows(sequences.numbered(df, ["k"], ["o", "v"], "n", s)) == rows(sequences.numbered(df, ["k"], ["o", "v"], "n"))
        got = sequences.inherited(df.where("o is not null").dropDuplicates(["k", "o"]), ["k"], ["o"], "v", "w", s)
        assert rows(got) == rows(sequences.inherited(df.where("o is not null").dropDuplicates(["k", "o"]), ["k"], ["o"], "v", "w"))


def test_percentiles_of_many_values(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") * 7919 % 10_007).alias("v"))
    got = {r["k"]: r for r in register.percentile_rank(df, ["k"], "v", [0, 50, 99, 100]).collect()}
    for k in (0, 1):
        v = sorted(i * 7919 % 10_007 for i in range(20_000) if i % 2 == k and i % 5)
        assert [got[k][f"p{p}"] for p in (0, 50, 99, 100)] == [v[int(p / 100 * (len(v) - 1))] for p in (0, 50, 99, 100)]
