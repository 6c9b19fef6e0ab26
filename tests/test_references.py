import datetime as dt

import pytest

from pandect.operators.law_references import found, masks
from pandect.operators.references import orphans
from tests.conftest import rows

D = lambda n: dt.datetime(2022, 1, n)
REF = "id int, a string, b string, arrived_at timestamp_ntz"
REC = "a string, b string, arrived_at timestamp_ntz"


@pytest.fixture
def refs(spark):
    return spark.createDataFrame([(1, "x", "1", D(5)), (2, "x", None, D(5)), (3, None, "9", D(5)), (4, None, None, D(5)), (5, "z", "1", D(5)), (6, "y", "2", D(5)), (7, "y", "2", None), (8, "g", "1", D(5)), (9, "h", "1", D(5))], REF)


@pytest.fixture
def recs(spark):
    return spark.createDataFrame([("x", "1", D(1)), ("x", "1", D(9)), ("y", "2", D(8)), (None, "1", D(1)), ("g", "1", D(1)), ("h", "1", D(1)), ("h", "1", D(4))], REC)


@pytest.fixture
def gone(spark):
    return spark.createDataFrame([("g", "1", D(3)), ("h", "1", D(3)), ("z", None, D(3)), ("q", "1", None)], "a string, b string, removed_at timestamp_ntz")


@pytest.mark.parametrize(
    ("match", "want"),
    [
        ("simple", [(5, "missing"), (6, "late"), (8, "deleted")]),
        ("partial", [(3, "missing"), (5, "missing"), (6, "late"), (8, "deleted")]),
        ("full", [(2, "missing"), (3, "missing"), (5, "missing"), (6, "late"), (8, "deleted")]),
    ],
)
def test_match_semantics(refs, recs, gone, match, want):
    assert rows(orphans(refs, recs, ["a", "b"], match, removed=gone).select("id", "kind")) == want


def test_unknown_semantics(refs, recs):
    with pytest.raises(ValueError, match="match"):
        orphans(refs, recs, ["a", "b"], "fuzzy")


def test_empty_tables(spark, refs, recs):
    none = spark.createDataFrame([], REC)
    assert orphans(refs.limit(0), recs, ["a", "b"]).count() == 0
    assert {k for _, k in rows(orphans(refs, none, ["a", "b"], "simple").select("id", "kind"))} == {"missing"}


def test_register(spark):
    law = "name string, amending array<string>, amended_by array<string>, linked_amending array<string>, updated_at timestamp_ntz, synced_at timestamp_ntz, type string"
    laws = spark.createDataFrame(
        [
            ("UK_uksi_2000_1", [" uk-uksi-2000-2 ", "UK_UKSI_2000_2", "", None, "https://x.example/id/ukpga/1999/9"], None, [], D(2), D(3), "clash"),
            ("UK_uksi_2000_1", ["/asp/1/1"], None, None, D(1), D(9), None),
            ("UK_uksi_2000_2", None, ["UK_uksi_2000_1", "no law"], None, D(2), D(1), None),
            ("UK_uksi_2000_3", ["UK_uksi_2000_2"], None, None, None, D(1), None),
            ("UK_uksi_2000_4", ["uksi 2000", "ukpga 2000", "2000/2", "2001/7", "odd law"], None, None, D(2), D(3), None),
            ("odd law", None, None, None, None, D(1), None),
        ],
        law,
    )
    units = spark.createDataFrame([("s1", D(1)), ("s2", D(9))], "section_id string, synced_at timestamp_ntz")
    notes = spark.createDataFrame([("n1", ["s1", "\ts2 ", "s3", " ", None, "s3"], D(2), D(3)), ("n2", None, D(2), D(3)), ("n3", ["s1"], None, D(3))], "id string, affected_sections array<string>, updated_at timestamp_ntz, synced_at timestamp_ntz")
    removed = spark.createDataFrame([("uk_lrt", "UK_ukpga_1999_9", D(1)), ("lat", "s1", D(2)), ("lat", None, D(2)), (None, "s2", D(2))], "table_name string, record_key string, removed_at timestamp_ntz")
    assert rows(found(laws, units, notes, removed)) == [
        ("amendment_annotations", "n1", "affected_sections", "s1", "deleted", "2022-01"),
        ("amendment_annotations", "n1", "affected_sections", "s2", "late", "2022-01"),
        ("amendment_annotations", "n1", "affected_sections", "s3", "missing", "2022-01"),
        ("uk_lrt", "UK_uksi_2000_1", "amending", "UK_ukpga_1999_9", "deleted", "2022-01"),
        ("uk_lrt", "UK_uksi_2000_2", "amended_by", "UK_uksi_2000_1", "late", "2022-01"),
        ("uk_lrt", "UK_uksi_2000_2", "amended_by", "no law", "missing", "2022-01"),
        # What a reference has must match some law: a type and year, or a year and number.
        ("uk_lrt", "UK_uksi_2000_4", "amending", "2001/7", "missing", "2022-01"),
        ("uk_lrt", "UK_uksi_2000_4", "amending", "ukpga 2000", "missing", "2022-01"),
    ]
    of_laws = {r["null_keys"]: r["references"] for r in masks(laws, units, notes, removed).where("source_table = 'uk_lrt'").groupBy("null_keys").sum("references").toDF("null_keys", "references").collect()}
    assert of_laws == {"text": 3, "type,year,number": 2, "number,text": 2, "type,text": 2}
    assert found(laws.limit(0), units.limit(0), notes.limit(0), removed.limit(0)).count() == 0
