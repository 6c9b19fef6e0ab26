import re

from pandect.operators import legacy_texts as L

AFFECTS = re.compile(L.affect_pattern(["words", "repealed"]))


def test_rules():
    text = "[Org: A]\nhttps://x.example/uksi/2000/1/regulation/4\nDUTY\n\U0001f464Org: A\n\U0001f4ccclean it\n\U0001f4cc\n[B]\n\U0001f4cclost\nhttps://x.example/uksi/2000/1/s-2\n\U0001f4cckeep"
    assert L.rules_of(text, "X") == [
        {"holder": "Org: A", "article": "regulation/4", "duty_type": "DUTY", "clause": "clean it"},
        {"holder": "Org: A", "article": "regulation/4", "duty_type": "X", "clause": None},
        {"holder": "B", "article": "s-2", "duty_type": "X", "clause": "keep"},
    ]
    assert L.rules_of("nothing here", "X") is None


def test_stats_of_merged_blocks():
    text = "stray\n2 - Law One\nhttps://x.example/id/uksi/2001/5\n s. 1 words omitted [Yes]\n words\n1 - No link\n x\n3 - Law Two\n\nhttps://x.example/uksi/2001/6\n s. 2 repealed in part [Not yet]\n https://x.example/other"
    got = L.stats_of(text, AFFECTS)
    assert list(got) == ["UK_uksi_2001_5", "UK_uksi_2001_6"]
    assert got["UK_uksi_2001_5"]["details"] == [{"target": "s. 1", "affect": "words omitted", "applied": "Yes"}, {"target": "words", "affect": None, "applied": None}]
    assert got["UK_uksi_2001_6"]["count"] == 3 and got["UK_uksi_2001_6"]["details"][0]["affect"] == "repealed in part"
    assert L.stats_of("", AFFECTS) is None


def test_logs():
    text = "orphan\n1/12/2024\n\U0001f53a_stats_count\nnil -> 0\nAmended_by\nUK_uksi_2024_1\n2/1/2025\nother\n\U0001f53b_stats_x\n1 -> nil"
    a, b = L.log_of(text)
    assert a["timestamp"] == "2024-12-01T00:00:00Z" and a["summary"] == "Updated 2 fields: amended_by, amending_stats_count"
    assert a["changes"] == {"amending_stats_count": {"old": None, "new": "0"}, "amended_by": {"old": None, "new": "UK_uksi_2024_1"}}
    assert b["changes"] == {"amended_by_stats_x": {"old": "1", "new": None}} and b["summary"] == "Updated 1 field: amended_by_stats_x"
    assert L.log_of("no date") is None


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None,), ("",), ("1/1/2020",)], "t string")
    assert [r[0] and r[0][0]["summary"] for r in df.select(L.log_from_text(F.col("t"))).collect()] == [None, None, "No changes"]
    v = spark.createDataFrame([(["a", "b"],), (None,)], "v array<string>")
    assert [r[0] for r in v.select(L.renamed(F.col("v"), {"a": "x"})).collect()] == [["x", "b"], None]
    assert df.limit(1).select(L.line_ends(F.lit("a~b"), "~")).first()[0] == "a\nb"
