"""Worked examples of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pandect.functions import citations as C
from pandect.functions import extents as X
from pandect.functions import taxa
from pandect.functions import titles as T
from pandect.functions.keys import law_key
from pandect.functions.text import squeeze_blanks, strip_blanks, token_count
from pandect.functions.times import iso_micros, iso_or, utc_text
from pandect.operators import roles


def of(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (C.sort_key, {"3": "003.000.000", "3A": "003.010.000", "3ZA": "003.001.000", "3AB": "003.010.020", "19DZA": "019.040.001", "19AZA": "019.010.001", "": "000.000.000", None: "000.000.000", "3a": "003.010.000", "1200": "1200.000.000", "9" * 30: "000.000.000", "Z": "000.260.000"}),
        (law_key, {"uk_uksi_2001_5": "UK_uksi_2001_5", " UK-UKSI-2001-5 ": "UK_uksi_2001_5", "/uksi/2001/5": "UK_uksi_2001_5", "https://x.example/id/uksi/2001/5": "UK_uksi_2001_5", "\t": None, None: None, "\xa0what ": "what"}),
        (C.without_acronym, {"UK_CMCHA_ukpga_2007_19": "UK_ukpga_2007_19", "UK_ukpga_1974_37_HSWA": "UK_ukpga_1974_37", "UK_1988_819_CDWR": "UK_1988_819", " UK_uksi_2000_1 ": "UK_uksi_2000_1", None: None}),
        (C.law_of_annotation_id, {"UK_ukpga_2006_19_CCSEA_F1": "UK_ukpga_2006_19", "_F25": None, "UK_x'y_1_F1": None, None: None}),
        (C.code_type, {"F1": "amendment", "C42": "modification", "I3": "commencement", "E9": "extent_editorial", "X1": None, "": None}),
        (C.to_slash_form, {"UK_uksi_2020_1": "uksi/2020/1", "uksi/2020/1": "uksi/2020/1"}),
        (C.slug, {"The Kilns & Co. (1999)": "the-kilns-co-1999", "": "", None: None}),
        (T.acronym, {"Health and Safety at Work etc. Act 1974": "HSWA", "The Management of Health Regulations 1999": "MHR", None: None}),
        (T.type_class, {"A Act 1974": "Act", "B Regulations 2002": "Regulation", "C Rules": "Rules", "Bye-laws 1990": "Byelaws", "Regulation (EU) 1": "EU", "The thing": None}),
        (T.clean_title, {"The Kilns Act 1999": "Kilns Act", "Kilns Act (repealed 1.2.1999)": "Kilns Act", "Kilns\xa01999 (revoked)": "Kilns"}),
        (T.split_title, {"SI 2024/123 - The A - B": "The A - B", "Plain": "Plain"}),
        (T.date_in_words, {"at 3.32 p.m. on 10th September 2020": "2020-09-10", "1stApril 2004": "2004-04-01", "2020-01-02": "2020-01-02", "soon": None, "": None, None: None}),
        (T.title_status, {"A (revoked)": "❌ Revoked / Repealed / Abolished", "A (repealed in part)": "⭕ Part Revocation / Repeal", "A": None}),
        (X.code_of_region, {"England, Wales and Scotland": "E+W+S", "England": "E", "England and Northern Ireland": "E+NI", "Wales and Scotland": "Wales and Scotland", "GB only": "E+W+S", "UK": "E+W+S+NI", "": None}),
        (X.compact, {"(E+W)": "E+W", "EWS": "E+W+S", "e+w+s+n.i.": "E+W+S+NI", "": None}),
        (X.flags, {"E": X.FLAGS["E"] + " E", "E+W+S+NI": X.ALL_FLAG + " E+W+S+NI"}),
        (strip_blanks, {" \xa0a b　\n": "a b", "": "", None: None}),
        (squeeze_blanks, {" a \n b\t": "a b", "\xa0": ""}),
        (token_count, {"a b, c!": 5, "ŵyl é": 3, "": 0, None: 0, "٣٤ 漢字": 2}),
    ],
)
def test_examples(spark, fn, cases):
    assert dict(zip(cases, of(spark, list(cases), fn), strict=True)) == cases


def test_nations_and_regions(spark):
    assert of(spark, ["E+W+S+NI", "S+E", "X", None], X.nations) == [["England", "Wales", "Scotland", "Northern Ireland"], ["England", "Scotland"], [], None]
    assert of(spark, ["E+W+S+NI", "E+W+S", "E+S", "W+S", "NI"], lambda c: X.pan_region(X.nations(c))) == ["UK", "GB", "E+S", "W+S", "NI"]


def test_times(spark):
    cases = ["2022-01-01T00:30:00+01:00", "2022-01-01 00:30:00.5", "2022-01-01T00:30:00.123456Z", "2022-01-01", "2022-02-30 00:00:00", "unknown", "", None]
    assert of(spark, cases, lambda c: utc_text(iso_micros(c))) == ["2021-12-31 23:30:00", "2022-01-01 00:30:00", "2022-01-01 00:30:00", "2022-01-01 00:00:00", None, None, None, None]
    assert of(spark, ["no", "1970-01-01"], lambda c: iso_or(c, 30 * 86_400_000_000 + 5)) == [5, 0]
    assert of(spark, [-1, 0], utc_text, "bigint") == ["1969-12-31 23:59:59", "1970-01-01 00:00:00"]


def test_tags_and_lists(spark):
    assert of(spark, ["The Control of Kilns: and Peat 1999"], T.tags) == [["Control", "Kilns:", "Peat"]]
    assert of(spark, ["F1, F2,,C3 ", "", None], C.listed) == [["F1", "F2", "C3"], None, None]
    assert of(spark, [["F1", "F2", "C1"], ["C1"], None], lambda c: C.count_codes(c, "F"), "array<string>") == [2, None, None]


def test_paths_of_no_level(spark):
    df = spark.createDataFrame([("1", "", None), (None, None, None)], "p string, q string, r string")
    levels = {"part": F.col("p"), "chapter": F.col("q"), "sub": F.col("r")}
    assert [tuple(r) for r in df.select(C.hierarchy_path(levels), C.depth(levels)).collect()] == [("part.1", 1), (None, 0)]


def test_purposes(spark):
    assert of(spark, ["It is green.", "", None, "A person is liable to a penalty on conviction."], taxa.purposes) == [[taxa.DEFAULT_PURPOSE], [], [], ["Offence", "Enforcement+Prosecution", "Liability"]]
    assert of(spark, ["The ducks  quack", "duck"], lambda c: taxa.purposes(c, {"Noise": ["duck quack*", "ducks quack"], "Bird": ["duck"]}, "None")) == [["Noise", "Bird"], ["Bird"]]
    assert of(spark, ["a certificate", "x"], lambda c: taxa.categories(c, F.array(F.lit("Duty")))) == [["Records"], ["Risk Control"]]
    assert of(spark, ["x"], taxa.categories) == [[]]


def test_scores(spark):
    none = spark.range(1).select(taxa.making_score(taxa.signals(F.lit("A"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"))).alias("s"))
    assert none.first()[0] == taxa.PRIOR
    assert of(spark, ["", None, "The owner must keep it in good repair."], lambda c: taxa.clause_confidence(c, F.lit(True))) == [0.0, 0.0, 0.85]


LIB = roles.library_from_names(["Gvt: Upland Board", "Ind: Board", "Ind: Kiln Master"])


def test_actors_are_consumed():
    compiled = roles._compiled(LIB)
    assert roles.actors_in("The Upland Board and the kiln masters.", compiled) == ["Gvt: Upland Board", "Ind: Kiln Master"]
    assert roles.actors_in("the board, the upland board", compiled) == ["Gvt: Upland Board", "Ind: Board"]
    assert roles.actors_in(None, compiled) == roles.actors_in("", compiled) == []


def test_rules_of_a_text():
    lib = roles.rule_patterns(LIB)
    got = roles.clauses_in("Intro. The kiln master must clean each kiln. The Upland Board may by notice require it.", lib)
    assert ("Ind: Kiln Master", "DUTY", "The kiln master must clean each kiln.", True) in got
    assert any(g[:2] == ("Gvt: Upland Board", "POWER") for g in got)
    long = "x " * 40_000 + "The kiln master must clean it. " + "y " * 40_000
    assert [g[:2] for g in roles.clauses_in(long, lib)] == [("Ind: Kiln Master", "DUTY")]
    assert [g[:2] for g in roles.clauses_in(long, lib, large=1000)] == [("Ind: Kiln Master", "DUTY")]
    first = roles.clauses_in("The kiln must be kept by the kiln master. The Upland Board may act.", roles.first_patterns(LIB))
    assert {g[:2] for g in first} >= {("Ind: Kiln Master", "DUTY"), ("Gvt: Upland Board", "POWER")} and not any(g[3] for g in first)
    # Clauses that are alike in their first hundred characters are two; nothing is cut without being asked.
    same = "The kiln master must " + "clean and clean " * 8
    two = roles.clauses_in(f"{same}kilns. {same}hoists.", lib)
    assert len(two) == 2 and all(len(c) > 140 for _, _, c, _ in two)
    assert all(len(c) <= 103 for _, _, c, _ in roles.clauses_in(f"{same}kilns.", lib, longest=100))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 999), st.sampled_from(["", "A", "B", "ZA", "Z", "AB", "AZA"])), min_size=2, max_size=12, unique=True))
def test_keys_order_like_the_numbers(provisions):
    def key(n, s):
        out, i = [n], 0
        while i < len(s) and len(out) < 3:
            if s[i] == "Z" and i + 1 < len(s):
                out.append(ord(s[i + 1]) - 64)
                i += 2
            else:
                out.append((ord(s[i]) - 64) * 10)
                i += 1
        return tuple(out + [0] * (3 - len(out)))

    texts = {p: ".".join(f"{x:03d}" for x in key(*p)) for p in provisions}
    assert sorted(provisions, key=lambda p: texts[p]) == sorted(provisions, key=lambda p: key(*p))
