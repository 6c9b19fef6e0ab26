import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandect.sources import files, markup
from tests.conftest import rows

BODY = """<Legislation xmlns="urn:x"><Primary><Body>
<Part RestrictExtent="E+W+S"><Number>Part 1</Number><Title>Kilns</Title>
<Chapter><Number>Chapter 2</Number><Title>Fees</Title>
<Pblock><Title>Cleaning</Title>
<P1group><Title>x</Title><P1 id="s3"><Pnumber>3A</Pnumber><P1para><Text>Clean <CommentaryRef Ref="c1"/>it.</Text>
<P2 id="s3-1"><Pnumber>1</Pnumber><P2para><Text>At  once.</Text><P3><Pnumber>a</Pnumber><P3para><Text>or</Text></P3para></P3></P2para></P2></P1para></P1></P1group>
</Pblock></Chapter></Part>
<Part><Number>Part 2</Number><P1 RestrictExtent="N.I."><Pnumber>4</Pnumber><Text>End.</Text></P1></Part>
<Schedule><Number>SCHEDULE 1</Number><P1><Pnumber>5</Pnumber><Text>Extra.</Text></P1></Schedule>
</Body></Primary></Legislation>"""


def test_body_rows_inherit_and_reset():
    got = markup.unit_rows(BODY)
    short = [(r["section_type"], r["part"], r["chapter"], r["heading_group"], r["provision"], r["paragraph"], r["sub_paragraph"], r["schedule"], r["extent_code"]) for r in got]
    assert short == [
        ("part", "1", None, None, None, None, None, None, "E+W+S"),
        ("chapter", "1", "2", None, None, None, None, None, "E+W+S"),
        ("heading", "1", "2", "3A", None, None, None, None, "E+W+S"),
        ("section", "1", "2", "3A", "3A", None, None, None, "E+W+S"),
        ("sub_section", "1", "2", "3A", "3A", "1", None, None, "E+W+S"),
        ("paragraph", "1", "2", "3A", "3A", "1", "a", None, "E+W+S"),
        ("part", "2", None, None, None, None, None, None, None),
        ("section", "2", None, None, "4", None, None, None, "NI"),
        ("schedule", None, None, None, None, None, None, "1", None),
        ("section", None, None, None, "5", None, None, "1", None),
    ]
    assert [r["position"] for r in got] == list(range(1, 11))
    assert got[3]["text"] == "Clean it." and got[4]["text"] == "At once." and got[3]["refs"] == ["c1"]
    assert markup.unit_rows(BODY, "article")[3]["section_type"] == "article"
    assert markup.unit_rows("<a><b></a>") == markup.unit_rows("") == markup.unit_rows(None) == []


def test_other_xml():
    xml = '<r xmlns:u="urn:u"><u:Commentary id="c1" Type="F"><P>Word  one</P></u:Commentary><Commentary id="c2" Type="X"/><ContentsItem ContentRef="p1" RestrictExtent="E+W+N.I."/><ContentsItem ContentRef="p2"/><P1 id="p1">A</P1><P1>B</P1><P1/><title>T</title><BodyParagraphs Value="7"/><subject>s1</subject></r>'
    assert markup.commentary_rows(xml) == [{"ref": "c1", "code": "F1", "code_type": "amendment", "text": "Word one", "ordinal": 1}]
    assert markup.extent_rows(xml) == [{"provision": "p1", "extent": "E+W+NI"}]
    assert markup.section_rows(xml) == [{"section_ref": "p1", "text": "A"}, {"section_ref": "section-2", "text": "B"}]
    m = markup.metadata_row(xml)[0]
    assert (m["title"], m["body_paras"], m["schedule_paras"], m["subjects"], m["extent"]) == ("T", 7, None, ["s1"], "E+W+N.I.")
    assert markup.document_text("<a>x <b> y</b></a>") == [{"text": "x y"}]


CELLS = ["A title", "/id/uksi/2001/5", "s. 1", "repealed", "B title", "y", "z", "Yes", ""]


def table(link="/id/uksi/2001/5"):
    cells = [f'<td><a href="{link}">A title</a></td>', *[f"<td>{c}</td>" for c in CELLS[1:]]]
    return f"<table><thead><tr><th>h</th></tr></thead><tbody><tr>{''.join(cells)}</tr><tr><td>short</td></tr></tbody></table>"


def test_html():
    assert markup.change_rows(table()) == [{"name": "UK_uksi_2001_5", "title_en": "A title", "path": "/uksi/2001/5", "target": "s. 1", "affect": "repealed", "applied": "Yes"}]
    assert markup.change_rows(table("/nothing")) == [] and markup.change_rows(None) == [] and markup.change_rows("<td>") == []
    html = '<div class="p"><h6><a href="/a/1">One</a></h6><p>First.</p><h6><a href="/a/2">Two</a></h6><p>Second</p></div>'
    assert [(r["path"], r["title_en"], r["description"]) for r in markup.listing_rows(html)] == [("/a/2", "Two", "Second"), ("/a/1", "One", "First.")]


def test_shred_over_pages(spark):
    pages = spark.createDataFrame([("L1", BODY, 1), ("L2", "broken <", 2), ("L3", None, 3)], "name string, xml string, position int")
    got = markup.shred(pages, ["name"], "xml", markup.unit_rows, markup.UNIT_ROW)
    assert got.where("name = 'L1'").count() == 10 and got.count() == 10
    assert got.where("size(refs) = 1").count() >= 1
    web = spark.createDataFrame([(1, table()), (2, "<p>none</p>")], "id int, html string")
    assert [r[0] for r in web.where(markup.has_table(F.col("html"))).select("id").collect()] == [1]


def test_csv_update(spark, tmp_path):
    (tmp_path / "u.csv").write_text('﻿Name,Family,Year,Other\nL1,"NEW, A",,x\nL9,Z,2001,y\nL2,,2005,\n', encoding="utf-8")
    csv = files.read_csv(spark, str(tmp_path / "u.csv"), {"Name": "name", "Family": "family", "Year": "year", "Absent": "absent"})
    assert csv.columns == ["name", "family", "year", "absent"]
    state = spark.createDataFrame([("L1", "OLD", 1999, "keep"), ("L2", "B", None, None)], "name string, family string, year int, note string")
    assert rows(files.update_from_csv(state, csv)) == [("L1", "NEW, A", 1999, "keep"), ("L2", "B", 2005, None)]


def test_metrics(spark, tmp_path):
    folder = str(tmp_path / "log")
    ev = spark.createDataFrame([("2022-01-01T10:00:00", "parse", {"duration_us": 5}, {"law_name": "x"}), ("2022-01-02T10:00:00", "parse", {"duration_us": 7}, None)], files.METRIC)
    files.append_metrics(ev, folder)
    files.append_metrics(ev.limit(1), folder)
    assert files.read_metrics(spark, folder).count() == 3
    assert files.read_metrics(spark, folder, after="2022-01-01T10:00:00").count() == 1
    assert files.read_metrics(spark, folder, before="2022-01-02T10:00:00").count() == 2
    assert [r[0] for r in files.metric_days(spark, folder).collect()] == ["2022-01-02", "2022-01-01"]
    assert files.clear_metrics(spark, folder, "2022-01-01") and files.read_metrics(spark, folder).count() == 1
    assert files.clear_metrics(spark, folder)


def test_arrow_and_json(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n bigint, t string")
    payload = files.arrow_bytes(df, ["n"])
    assert pa.ipc.open_stream(payload).schema.field("n").type == pa.int32()
    assert rows(files.from_arrow_bytes(spark, payload)) == rows(df) and files.from_arrow_bytes(spark, payload, first_only=True).count() == 1
    assert [json.loads(x) for x in files.answer(df, "json")][0] == {"k": "a", "n": 1, "t": None}
    assert files.answer(df, "arrow")
    with pytest.raises(ValueError):
        files.answer(df, "xml")
    with pytest.raises(pa.ArrowInvalid):
        files.from_arrow_bytes(spark, b"junk")


def test_delimited_and_json_files(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], None)], "k string, l array<int>, extra string")
    assert files.write_delimited(df, str(tmp_path / "t"), ["l", "k", "z"]) == ["k", "l"]
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()] == [("a", "[1,2]")]
    (tmp_path / "s.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json(spark, str(tmp_path / "s.json"), T.StructType([T.StructField("a", T.IntegerType())])).count() == 2
    files.write_json(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 1
