"""Vocabularies and links over titles and texts, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pandect.operators import matching, register
from pandect.queries.sql import NL, NU
from pandect.sources.tables import table

VOCABULARY = [("WATER", ["sluice", "spillway", "culvert"]), ("FIRE", ["kiln", "furnace", "chimney"]), ("TRADE", ["weighbridge", "dye"])]
PATTERNS = [r"\(Commencement", r"\(Fees\)", r"^The Rope"]
FAMILIES = {"TRAINING": "RECORDS", "STORAGE": "STORAGE: Oils", "CLOSURE": "PEAT & MOOR"}


def _laws(fn):
    return lambda spark, d: fn(register.laws(table(spark, d, "uk_lrt"), "title_en", "type_code", "year", "number", "live"))


def _units(fn):
    return lambda spark, d: fn(register.units(table(spark, d, "lat"), "law_name", "text"))


def _coded(x):
    """Codes from the first words in brackets of a title."""
    return x.withColumn("codes", matching.codes_of(F.regexp_extract("title_en", r"\(([^)]*)\)", 1)))


def _links(x):
    marks = F.create_map(F.lit("c00001"), F.array(F.concat_ws("/", F.lit("http://register.example/id"), "type_code", "year", "number")), F.lit("f00001"), F.array(F.lit("http://register.example/id/ukpga/1996/18"), F.lit("http://register.example/id/ukpga/1990/1")))
    text = F.concat(F.lit("In exercise of the powers conferred by c00001 and f00001, the Board makes "), F.coalesce("title_en", F.lit("")), F.lit(". The rest."))
    clause = matching.clause_of(text, "powers conferred")
    return x.select("name", clause.alias("clause"), F.array_join(matching.links_of_references(clause, marks, "register.example"), "|").alias("laws"), F.array_join(matching.links_with_years(text, F.array(F.lit("a/1996/1"), F.lit("b/2019/2"), F.lit("c/2001/3"))), "|").alias("by_year"))


QUERIES = {
    "title_exclusion": _laws(lambda x: x.select("name", matching.excluded(F.col("title_en"), PATTERNS).alias("excluded"))),
    "first_match_family": _units(lambda u: u.select("section_id", matching.first_match(F.col("text"), VOCABULARY).alias("family"))),
    "categorise_three_way": _laws(lambda x: matching.three_way(_coded(x), "title_en", "codes", FAMILIES, VOCABULARY, PATTERNS).select("name", "group", "family")),
    "selected_or_all": _laws(lambda x: matching.selected(x.withColumn("s", F.col("year") > 2015), "s").select("name", "year")),
    "selected_none": _laws(lambda x: matching.selected(x.withColumn("s", F.col("year") > 9999), "s").select("name", "year")),
    "specific_acts": _units(lambda u: u.select("section_id", F.array_join(matching.specific(F.col("text"), [("kiln master", "ukpga/1987/5001"), ("Tribunal", "asp/2009/5005")]), "|").alias("acts"))),
    "enabling_links": _laws(_links),
}


def _has(c: str, terms) -> str:
    return " OR ".join(f"contains(lower({c}), '{t}')" for t in terms)


_FIRST = "CASE " + " ".join(f"WHEN {_has('{c}', t)} THEN '{n}'" for n, t in VOCABULARY) + " END"
_EXCLUDED = "coalesce(regexp_matches(title_en, '" + "|".join(f"(?:{p})" for p in PATTERNS) + "'), false)"
_CODES = "list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(upper(regexp_extract(title_en, '\\(([^)]*)\\)', 1)), '[;,]'), lambda x: trim(x)), lambda x: x NOT IN ('ENGLAND AND WALES', 'ENGLAND & WALES', 'ENGLAND', 'WALES', 'SCOTLAND', 'NORTHERN IRELAND', ''))))"
_FAMILY = "list_filter(list_transform(codes, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " END), lambda x: x IS NOT NULL)[1]"
ORACLE = {
    "title_exclusion": f"WITH {NL} SELECT name, {_EXCLUDED} AS excluded FROM nl",
    "first_match_family": f"WITH {NU} SELECT section_id, {_FIRST.replace('{c}', 'text')} AS family FROM nu",
    "categorise_three_way": f"WITH {NL}, c AS (SELECT *, {_CODES} AS codes FROM nl), f AS (SELECT name, {_EXCLUDED} AS ex, {_FAMILY} AS bc, {_FIRST.replace('{c}', 'title_en')} AS bt FROM c), g AS (SELECT *, CASE WHEN ex THEN 3 WHEN bc IS NOT NULL THEN 1 WHEN bt IS NOT NULL THEN 2 ELSE 3 END AS \"group\" FROM f) SELECT name, \"group\", CASE \"group\" WHEN 1 THEN bc WHEN 2 THEN bt END AS family FROM g",
    "selected_or_all": f"WITH {NL} SELECT name, year FROM nl WHERE year > 2015",
    "selected_none": f"WITH {NL} SELECT name, year FROM nl",
    "specific_acts": f"WITH {NU} SELECT section_id, CASE WHEN text IS NOT NULL THEN concat_ws('|', CASE WHEN contains(text, 'kiln master') THEN 'ukpga/1987/5001' END, CASE WHEN contains(text, 'Tribunal') THEN 'asp/2009/5005' END) END AS acts FROM nu",
    "enabling_links": f"""WITH {NL}, t AS (SELECT name, type_code, year, number, 'In exercise of the powers conferred by c00001 and f00001, the Board makes ' || coalesce(title_en, '') || '. The rest.' AS x FROM nl)
      SELECT name, regexp_extract(x, '(?s)(powers conferred.*?\\.)\\s+[A-Z]', 1) AS clause, CASE WHEN type_code IN ('ukpga', 'anaw', 'asp', 'nia', 'apni', 'ukla', 'eur', 'eudr', 'eut') THEN concat_ws('/', type_code, year, number) ELSE 'ukpga/1996/18' END AS laws,
      concat_ws('|', CASE WHEN regexp_matches(x, '\\b1996\\b') THEN 'a/1996/1' END, CASE WHEN regexp_matches(x, '\\b2019\\b') THEN 'b/2019/2' END, CASE WHEN regexp_matches(x, '\\b2001\\b') THEN 'c/2001/3' END) AS by_year FROM t""",
}
