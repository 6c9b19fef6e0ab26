"""Territorial extents: codes, nations, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandect.functions.citations import filled

# Codes of nations in their order, and their names.
NATIONS = {"E": "England", "W": "Wales", "S": "Scotland", "NI": "Northern Ireland"}
# The flags of the nations and of all four together.
FLAGS = {
    "E": "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f",
    "W": "\U0001f3f4\U000e0067\U000e0062\U000e0077\U000e006c\U000e0073\U000e007f",
    "S": "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f",
    "NI": "\U0001f3f4\U000e0067\U000e0062\U000e006e\U000e0069\U000e0072\U000e007f",
}
ALL_FLAG = "\U0001f1ec\U0001f1e7"


def _ordered(test) -> Column:
    """Codes of the nations for which ``test`` holds, in order."""
    return F.array_compact(F.array(*[F.when(test(code, name), code) for code, name in NATIONS.items()]))


def code_of_region(region: Column) -> Column:
    """Code of a region in words. Sets that have no code of their own, such as
    Wales with Scotland, keep their text."""
    r = F.trim(region)
    has = {code: r.contains(name) for code, name in NATIONS.items()}
    known = has["E"] & ~(has["S"] & has["NI"] & ~has["W"])
    joined = F.array_join(_ordered(lambda code, _: has[code]), "+")
    alone = F.array_join(_ordered(lambda _, name: r == name), "")
    return (
        F.when(r == "", F.lit(None))
        .when(known & (F.size(_ordered(lambda code, _: has[code])) > 1), joined)
        .when(alone != "", alone)
        .when(r.startswith("GB"), "E+W+S")
        .when(r.startswith("UK"), "E+W+S+NI")
        .otherwise(r)
    )


def code_of_xml(extent: Column) -> Column:
    """``E+W+S+N.I.`` as ``E+W+S+NI``."""
    return filled(F.trim(F.replace(extent, F.lit("N.I."), F.lit("NI"))))


def compact(extent: Column) -> Column:
    """Upper case without dots, blanks and brackets, short forms written out."""
    t = F.regexp_replace(F.upper(extent), r"[. ()]", "")
    return F.when(t == "EW", "E+W").when(t == "EWS", "E+W+S").otherwise(filled(t))


def nations(extent: Column) -> Column:
    """Names of the nations of a code, in order; none for an unknown code."""
    parts = F.split(extent, r"\+")
    codes = list(NATIONS)
    valid = F.forall(parts, lambda p: p.isin(*codes))
    names = F.array_compact(F.array(*[F.when(F.array_contains(parts, c), n) for c, n in NATIONS.items()]))
    return F.when(valid, names).when(extent.isNotNull(), F.array().cast("array<string>"))


def pan_region(names: Column) -> Column:
    """One code for a set of nations."""
    has = lambda n: F.array_contains(names, n)
    joined = F.array_join(_ordered(lambda _, name: has(name)), "+")
    return F.when(names.isNull(), F.lit(None)).when(joined == "E+W+S+NI", "UK").when(joined == "E+W+S", "GB").otherwise(joined)


def flags(extent: Column) -> Column:
    """A code behind the flags of its nations."""
    made = F.array_compact(F.array(*[F.when(F.array_contains(F.split(extent, r"\+"), c), f) for c, f in FLAGS.items()]))
    return F.when(extent == "E+W+S+NI", F.concat(F.lit(f"{ALL_FLAG} "), extent)).otherwise(F.concat(F.array_join(made, " "), F.lit(" "), extent))


def geography(units: DataFrame) -> DataFrame:
    """Per law: its extents (longest first), nations, one code for them, and
    the number of provisions of each extent."""
    rows = units.withColumn("extent", compact(F.col("extent_code"))).where("extent is not null and law_name is not null")
    per = rows.groupBy("law_name", "extent").agg(F.count(F.lit(1)).alias("n"))
    listed = per.groupBy("law_name").agg(F.array_sort(F.collect_list(F.struct((-F.octet_length("extent")).alias("o"), "extent", "n"))).alias("x"))
    names = F.array_distinct(F.flatten(F.transform("x", lambda e: nations(e["extent"]))))
    ordered = F.array_compact(F.array(*[F.when(F.array_contains(names, n), n) for n in NATIONS.values()]))
    out = listed.select("law_name", F.transform("x", lambda e: e["extent"]).alias("extents"), ordered.alias("geo_region"), F.transform("x", lambda e: F.concat_ws(": ", e["extent"], e["n"].cast("string"))).alias("detail"))
    return out.withColumn("geo_pan_region", pan_region(F.col("geo_region"))).withColumn("detail", F.array_join("detail", "; "))
