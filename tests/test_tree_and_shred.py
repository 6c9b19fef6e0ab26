import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pandect.operators import law_documents
from pandect.operators.law_totals import heavy, law_totals
from pandect.operators.shredding import _deep, adjacency, entities, nodes_of
from pandect.operators.tree_aggregate import merges, rounds_for, tree_aggregate
from tests.conftest import rows


@pytest.mark.parametrize(("chunk", "fan"), [(7, 3), (65_536, 16), (100, 2)])
def test_tree_equals_plain_aggregation(spark, chunk, fan):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 5, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    states = {"n": (F.lit(1).cast("bigint"), "sum"), "least": (F.col("id"), "min"), "most": (F.col("id"), "max"), "even": (F.col("id") % 2 == 0, "any")}
    got = tree_aggregate(df.repartition(6), ["k"], states, chunk, fan)
    want = df.groupBy("k").agg(F.count("*"), F.min("id"), F.max("id"), F.bool_or(F.col("id") % 2 == 0))
    assert rows(got) == rows(want)


def test_rounds_grow_with_the_logarithm():
    assert [rounds_for(n, 10) for n in (0, 10, 11, 1000, 100_000)] == [0, 0, 1, 2, 4]


@pytest.mark.parametrize("partitions", [1, 7])
def test_no_merge_takes_more_than_the_fan_in(spark, partitions):
    df = spark.range(0, 20_000, 1, partitions).select(F.lit("hot").alias("k"))
    steps = merges(df, ["k"], {"n": (F.lit(1).cast("bigint"), "sum")}, chunk_rows=20, fan_in=16)
    assert steps[0].count() >= 1000
    for step, after in zip(steps, [*steps[1:], None], strict=True):
        slot = F.lit(0) if after is None else F.floor(F.col("__slot") / 16)
        most = step.groupBy("k", slot.alias("s")).count().agg(F.max("count")).first()[0]
        assert most <= 16


def test_heavy_laws(spark):
    u = [(f"s{i}", "UK_uksi_2000_1" if i < 30 else f"UK_uksi_2001_{i}", "a  b", None, None) for i in range(100)]
    u += [("s1", "uk-uksi-2000-1", None, None, None), (None, "UK_x_2000_1", "", None, None), ("s500", None, "x", None, None)]
    units = spark.createDataFrame(u, "section_id string, law_name string, text string, updated_at timestamp_ntz, synced_at timestamp_ntz")
    notes = spark.createDataFrame([], "id string, law_name string, text string, updated_at timestamp_ntz, synced_at timestamp_ntz")
    assert rows(heavy(units, notes)) == [("lat", "UK_uksi_2000_1")]
    total = {r["law_name"]: (r["items"], r["share"]) for r in law_totals(units, notes).collect()}
    assert total["UK_uksi_2000_1"] == (30, round(30 / 101, 6)) and None not in total
    assert heavy(units.limit(0), notes).count() == 0


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


def rebuild(nodes, n=0):
    """The document again from its adjacency rows."""
    kind, scalar = nodes[n][4], nodes[n][5]
    kids = sorted((x for x in nodes if x[1] == n), key=lambda x: x[3])
    if kind == "object":
        return {x[2]: rebuild(nodes, x[0]) for x in kids}
    if kind == "array":
        return [rebuild(nodes, x[0]) for x in kids]
    return {"null": lambda: None, "boolean": lambda: scalar == "true", "number": lambda: json.loads(scalar), "string": lambda: scalar}[kind]()


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_round_trip(doc):
    if isinstance(doc, str):
        doc = [doc]
    assert rebuild(nodes_of(json.dumps(doc))) == doc


def test_broken_and_layered_texts():
    assert nodes_of(None) == [] and nodes_of("") == [] and nodes_of('{"a": tr') == [] and nodes_of('"{\\"a\\": t"') == []
    assert [n[4] for n in nodes_of(json.dumps(json.dumps(json.dumps({"a": 1}))))] == ["object", "number"]
    assert len(nodes_of("[" * 500 + "]" * 500)) == 500


def test_depth_is_not_limited():
    n = 200_000
    deep = nodes_of("[" * n + ' {"a": [1, "x\\n", null, {}, []], "b": -1.5e3} ' + "]" * n)
    assert len(deep) == n + 8 and deep[-1][1:6] == (n, "b", 2, "number", "-1500.0")
    assert nodes_of("[" * n + "]" * (n - 1)) == [] and nodes_of("[" * n + "]" * n + ",") == []


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_both_parsers_agree(doc):
    text = json.dumps(doc, indent=1)
    assert _deep(text) == doc
    for broken in (text[:-1], text + "}", text.replace(":", "", 1), text.replace(",", ";", 1)):
        try:
            want = json.loads(broken)
        except ValueError:
            with pytest.raises(ValueError):
                _deep(broken)
        else:
            assert _deep(broken) == want


def test_keys_with_dots_and_brackets_are_told_apart():
    a, b = nodes_of('{"a.b": 1, "c[]": 2}'), nodes_of('{"a": {"b": 1}, "c": [2]}')
    assert {x[6] for x in a} & {x[6] for x in b} == {"$"}


def test_entities_keep_parents(spark):
    docs = spark.createDataFrame([("d", '{"x": [{"a": "1", "b": null}, {"a": 2, "c": [1]}, 5, null]}', 1), ("e", None, 2), ("f", "{", 3), ("g", "{}", 4)], "k string, doc string, node int")
    nodes = adjacency(docs.select("k", "doc"), ["k"], "doc")
    got = rows(entities(nodes, ["k"], F.col("path") == "$.x[]", ["a", "b"]).select("k", "parent", "ordinal", "field_a", "field_b"))
    assert got == [("d", 1, 1, "1", None), ("d", 1, 2, "2", None)]


def test_register_documents(spark):
    stat = "map<string,struct<name:string,title:string,url:string,count:int,details:array<struct<target:string,affect:string,applied:string>>>>"
    schema = f"name string, duty_holder string, popimar string, affected_by_stats_per_law {stat}, updated_at timestamp_ntz, synced_at timestamp_ntz, field string"
    import datetime as dt

    t = dt.datetime(2022, 1, 1)
    laws = spark.createDataFrame(
        [
            ("A", '{"entries": [{"holder": " H1 "}, {"holder": null}, {}, {"holder": "H1"}, 7], "holders": ["H1", "H2  ", null, " "]}', '"[\\"C1\\", \\"C1 \\"]"', {"X": ("X", None, None, 1, [("t", None, None), None, (None, None, None)]), "Y": None, "Z": ("Z", None, None, 0, None)}, t, t, "clash"),
            ("B", '{"H1": true, "H2": false, " H3": true}', '{"values": ["C1", null]}', None, t, t, None),
            ("C", '["H1"', "null", {}, t, t, None),
            ("D", '"just text"', "[]", None, t, None, None),
            ("E", '{"H": true}', None, None, None, t, None),
        ],
        schema,
    )
    want = [("A", "duty_holder", "H1", 0), ("A", "duty_holder", "H1", 1), ("A", "duty_holder", "H1", 4), ("A", "duty_holder", "H2", 0), ("A", "popimar", "C1", 0)]
    want += [("A", "affected_by_stats_per_law", k, n) for k, n in (("X", 0), ("X", 1), ("X", 3), ("Y", 0), ("Z", 0))]
    want += [("B", "duty_holder", "H1", 0), ("B", "duty_holder", "H3", 0), ("B", "popimar", "C1", 0)]
    assert rows(law_documents.found(laws)) == sorted(want, key=repr)
    assert law_documents.found(laws.limit(0)).count() == 0
