"""Problem 2 on the register: references of laws and annotations.

Both kinds of reference have one composite key: the table that is referred to,
a law's type, year and number, and a ``text`` for keys that have no parts. Laws
leave ``text`` null; text units leave the law's parts null, as does a law
reference from which nothing can be read; a reference to a law without its type
or number leaves that part null too. They are matched ``partial``: on the parts
that a reference has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandect.functions.keys import law_key, law_parts
from pandect.functions.text import strip_blanks
from pandect.operators.references import counts, mask_counts, orphans
from pandect.plans.newest import newest

FIELDS = ("amending", "amended_by", "linked_amending")
KEY = ("target", "type", "year", "number", "text")
LAWS, UNITS = "uk_lrt", "lat"


def _law(c) -> list:
    """``KEY`` of a law: its parts, or its text if none can be read."""
    kind, year, number = law_parts(c)
    text = F.when(kind.isNull() & year.isNull() & number.isNull(), c)
    return [F.lit(LAWS).alias("target"), kind.alias("type"), year.alias("year"), number.alias("number"), text.alias("text")]


def _unit(c) -> list:
    part = F.lit(None).cast("string")
    return [F.lit(UNITS).alias("target"), part.alias("type"), part.alias("year"), part.alias("number"), c.alias("text")]


def law_references(laws: DataFrame) -> DataFrame:
    """One row per law, field and referenced law: its ``KEY``, its text
    ``ref_key``, and where it comes from. Spellings of one key within a field
    count once."""
    rows = newest(laws, "name", FIELDS)
    lists = [F.struct(F.lit(f).alias("field"), F.array_distinct(F.transform(f, law_key)).alias("refs")) for f in FIELDS]
    one = rows.select("name", "updated_at", "synced_at", F.inline(F.array(*lists)))
    one = one.select("name", "field", "updated_at", "synced_at", F.explode("refs").alias("ref_key")).where(F.col("ref_key").isNotNull())
    return one.select(F.lit(LAWS).alias("source_table"), F.col("name").alias("source_key"), "field", "ref_key", F.date_format("updated_at", "yyyy-MM").alias("period"), F.col("synced_at").alias("arrived_at"), *_law(F.col("ref_key")))


def unit_references(annotations: DataFrame) -> DataFrame:
    rows = newest(annotations, "id", ["affected_sections"])
    refs = F.array_distinct(F.transform("affected_sections", strip_blanks))
    one = rows.select("id", "updated_at", "synced_at", F.explode(refs).alias("ref_key")).where("ref_key <> ''")
    return one.select(F.lit("amendment_annotations").alias("source_table"), F.col("id").alias("source_key"), F.lit("affected_sections").alias("field"), "ref_key", F.date_format("updated_at", "yyyy-MM").alias("period"), F.col("synced_at").alias("arrived_at"), *_unit(F.col("ref_key")))


COLUMNS = ("source_table", "source_key", "field", "ref_key", "kind", "period")


def _references(laws: DataFrame, annotations: DataFrame) -> DataFrame:
    return law_references(laws).unionByName(unit_references(annotations))


def found(laws: DataFrame, units: DataFrame, annotations: DataFrame, removed: DataFrame) -> DataFrame:
    """Every orphan reference once."""
    records = laws.select(*_law(F.col("name")), F.col("synced_at").alias("arrived_at")).unionByName(units.select(*_unit(F.col("section_id")), F.col("synced_at").alias("arrived_at")))
    gone = removed.where(F.col("record_key").isNotNull())
    gone = gone.where(F.col("table_name") == LAWS).select(*_law(F.col("record_key")), "removed_at").unionByName(gone.where(F.col("table_name") == UNITS).select(*_unit(F.col("record_key")), "removed_at"))
    return orphans(_references(laws, annotations), records, KEY, match="partial", removed=gone).select(*COLUMNS)


def masks(laws: DataFrame, units: DataFrame, annotations: DataFrame, removed: DataFrame) -> DataFrame:
    """``source_table, field, null_keys, references``: how many references have which null mask."""
    return mask_counts(_references(laws, annotations), KEY, ["source_table", "field"])


def report(laws: DataFrame, units: DataFrame, annotations: DataFrame, removed: DataFrame) -> DataFrame:
    """Orphan references per table, field, kind and month."""
    return counts(found(laws, units, annotations, removed), ["source_table", "field", "kind", "period"])
