"""Names, citations, sort keys and paths of laws and their units.

All are Catalyst expressions over columns; nothing here runs in Python.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of source rows and the unit types they become.
RECORD_TYPES = {
    "title": "title",
    "part": "part",
    "chapter": "chapter",
    "heading": "heading",
    "section": "section",
    "sub-section": "sub_section",
    "article": "article",
    "article,heading": "heading",
    "article,sub-article": "sub_article",
    "sub-article": "sub_article",
    "paragraph": "paragraph",
    "sub-paragraph": "sub_paragraph",
    "schedule": "schedule",
    "annex": "schedule",
    "table": "table",
    "sub-table": "table",
    "figure": "note",
    "signed": "signed",
    "commencement": "commencement",
    "table,heading": "heading",
}
# Elements of a law's XML and the unit types they become; two depend on the kind of law.
ELEMENTS = {
    "Part": "part",
    "Chapter": "chapter",
    "Pblock": "heading",
    "P3": "paragraph",
    "P4": "sub_paragraph",
    "Schedule": "schedule",
    "SignedSection": "signed",
    "Tabular": "table",
    "Figure": "note",
}
ELEMENTS_BY_KIND = {"section": {"P1": "section", "P2": "sub_section"}, "article": {"P1": "article", "P2": "sub_article"}}
# The letter that begins an annotation's code, and its type.
CODE_TYPES = {"F": "amendment", "C": "modification", "I": "commencement", "E": "extent_editorial"}
# Heading rows of annotations, which carry no text of the law.
NOTE_HEADINGS = ("commencement,heading", "modification,heading", "extent,heading", "editorial,heading", "subordinate,heading")
# Parts of a document that aren't schedules.
FLOWS = ("pre", "main", "post", "signed", "")
# Kinds of law that others can be made under.
ENABLING = ("ukpga", "anaw", "asp", "nia", "apni", "ukla", "eur", "eudr", "eut")

SORT_ZERO = "000.000.000"


def lookup(table: Mapping[str, str], c: Column) -> Column:
    """The value of a small fixed table, null for other keys."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def filled(c: Column) -> Column:
    """Null instead of empty text."""
    return F.nullif(c, F.lit(""))


def uk_id(kind: Column, year: Column, number: Column) -> Column:
    return F.concat(F.lit("UK_"), kind, F.lit("_"), year.cast("string"), F.lit("_"), number)


def slash_name(kind: Column, year: Column, number: Column) -> Column:
    return F.concat_ws("/", kind, year.cast("string"), number)


def to_key_form(c: Column) -> Column:
    """``a/b/c`` to ``UK_a_b_c``; other names stay."""
    return F.when(c.startswith("UK_"), c).when(c.contains("/"), F.concat(F.lit("UK_"), F.translate(c, "/", "_"))).otherwise(c)


def to_slash_form(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "^UK_", ""), "_", "/")


def without_acronym(c: Column) -> Column:
    """Older names carry the law's acronym before or behind type, year and number."""
    t = F.trim(c)
    word = "[A-Z][A-Z0-9&-]+"
    return (
        F.when(t.rlike(rf"^UK_{word}_[a-z]+_\d+_\d+"), F.regexp_replace(t, rf"^UK_{word}_([a-z]+_\d+_\d+)", "UK_$1"))
        .when(t.rlike(r"^UK_(?:[a-z]+_)?\d+_\d+_[A-Z]"), F.regexp_replace(t, rf"^(UK_(?:[a-z]+_)?\d+_\d+)_{word}$", "$1"))
        .otherwise(t)
    )


def law_of_reference(c: Column) -> Column:
    """A law's name from a column of references, null if it isn't one."""
    clean = without_acronym(c)
    return F.when(clean.rlike(r"^UK_[a-z]+_\d+_\d+$") | (clean != c), filled(clean))


def law_of_annotation_id(c: Column) -> Column:
    """From ``{law}_{code}``; null where there is no law before the code."""
    return law_of_reference(filled(F.regexp_extract(c, r"^(.{3,})_[FCIE]\d+$", 1)))


def code_type(code: Column) -> Column:
    return lookup(CODE_TYPES, F.substring(code, 1, 1))


def annotation_id(law: Column, kind: Column, number: Column) -> Column:
    return F.concat_ws(":", law, kind, number.cast("string"))


def listed(c: Column) -> Column:
    """Comma-separated text as an array of its non-empty parts, null without any."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def count_codes(codes: Column, letter: str) -> Column:
    """How many codes begin with a letter; null instead of 0."""
    return F.nullif(F.size(F.filter(codes, lambda x: x.startswith(letter))), F.lit(0))


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^\\x{feff}", "")


def section_type(record_type: Column) -> Column:
    return lookup(RECORD_TYPES, F.trim(record_type))


def is_content(record_type: Column) -> Column:
    """Whether a source row holds text of the law rather than an annotation."""
    t = F.trim(record_type)
    return F.coalesce(~(t.isin("", *NOTE_HEADINGS) | t.endswith(",content") | t.rlike("^(?:amendment|subordinate|editorial),")), F.lit(False))


def element_type(element: Column, kind: str = "section") -> Column:
    return lookup({**ELEMENTS, **ELEMENTS_BY_KIND[kind]}, element)


def schedule_of_flow(flow: Column) -> Column:
    t = F.trim(flow)
    return F.when(~t.isin(*FLOWS), t)


def sort_key(c: Column) -> Column:
    """Sortable form of a provision number: digits, then up to two suffixes.

    A letter counts in tens (A 10 to Z 260), a letter behind Z in ones (ZA 1 to
    ZZ 26), so 3 < 3ZA < 3A < 3AB. Numbers above 999 keep all their digits;
    those that no 64-bit integer holds count as 0.
    """
    t = F.upper(F.trim(c))
    pattern = r"^(\d*)(Z[A-Z]|[A-Z])?(Z[A-Z]|[A-Z])?"
    suffix = lambda i: F.regexp_extract(t, pattern, i)
    rank = lambda s: F.when(s == "", 0).when(F.length(s) == 2, F.ascii(F.substring(s, 2, 1)) - 64).otherwise((F.ascii(s) - 64) * 10)
    number = F.coalesce(suffix(1).try_cast("bigint"), F.lit(0))
    made = F.format_string("%03d.%03d.%03d", number, rank(suffix(2)), rank(suffix(3)))
    return F.when(t.isNull() | (t == ""), SORT_ZERO).otherwise(made)


def unit_sort_key(kind: Column, provision: Column, heading: Column, paragraph: Column, extent: Column) -> Column:
    """A unit's key by its type, with the extent behind ``~`` for parallel provisions."""
    base = (
        F.when(kind.isin("section", "sub_section", "article", "sub_article"), sort_key(provision))
        .when(kind == "heading", sort_key(heading))
        .when(kind.isin("paragraph", "sub_paragraph"), sort_key(F.coalesce(paragraph, provision)))
        .otherwise(SORT_ZERO)
    )
    return F.concat(base, F.lit("~"), F.coalesce(extent, F.lit("")))


#: Levels of a path in order, and the columns they come from. Fixed values.
LEVELS = (("schedule", "schedule"), ("part", "part"), ("chapter", "chapter"), ("heading", "heading_group"), ("provision", "provision"), ("sub", "paragraph"), ("para", "sub_paragraph"))


def hierarchy_path(columns: Mapping[str, Column]) -> Column:
    """``level.value`` of the levels that have one, joined by slashes; null for none."""
    parts = [F.when(filled(columns[level]).isNotNull(), F.concat(F.lit(f"{level}."), columns[level])) for level, _ in LEVELS if level in columns]
    return filled(F.concat_ws("/", *parts))


def depth(columns: Mapping[str, Column]) -> Column:
    """The number of levels that have a value."""
    return sum((F.when(filled(c).isNotNull(), 1).otherwise(0) for c in columns.values()), F.lit(0))


def citation(kind: Column, provision: Column, sub: Column, paragraph: Column, sub_paragraph: Column, schedule: Column, heading: Column, part: Column, chapter: Column, position: Column, is_regulation: Column) -> Column:
    """Citation of a unit by its type; where its number is missing, by its position."""
    place = F.coalesce(position, F.lit(0)).cast("string")
    or_place = lambda c: F.coalesce(c, place)
    brackets = lambda *cs: F.concat(*[F.coalesce(F.concat(F.lit("("), c, F.lit(")")), F.lit("")) for c in cs])
    inside = F.coalesce(F.concat(F.lit("sch."), schedule, F.lit(".")), F.lit(""))
    numbered = F.concat(or_place(provision), brackets(sub, paragraph, sub_paragraph))
    item = F.coalesce(paragraph, provision, place)
    return (
        F.when(kind.isin("section", "sub_section"), F.concat(inside, F.lit("s."), numbered))
        .when(kind.isin("article", "sub_article"), F.concat(inside, F.when(is_regulation, "reg.").otherwise("art."), numbered))
        .when(kind == "schedule", F.concat(F.lit("sch."), or_place(schedule)))
        .when(kind == "part", F.concat(inside, F.lit("pt."), or_place(part)))
        .when(kind == "chapter", F.concat(inside, F.lit("ch."), or_place(chapter)))
        .when(kind == "heading", F.concat(inside, F.lit("h."), or_place(heading)))
        .when(kind == "paragraph", F.concat(inside, F.lit("para."), item, brackets(sub_paragraph)))
        .when(kind == "sub_paragraph", F.concat(inside, F.lit("para."), item, F.lit("("), or_place(sub_paragraph), F.lit(")")))
        .when(kind.isin("table", "note"), F.concat(inside, kind, F.lit("."), place))
        .otherwise(F.concat(kind, F.lit("."), place))
    )


def law_of_url(url: Column, host: str = "") -> Column:
    """``type/year/number`` of a link to a law; links to European acts have types of their own."""
    take = lambda pattern, prefix: F.when(url.rlike(pattern), F.concat_ws("/", *prefix, *[F.regexp_extract(url, pattern, i) for i in range(1, 4 - len(prefix))]))
    home = host.replace(".", r"\.")
    return F.coalesce(
        take(r"/id/([a-z]+)/(\d{4})/(\d+)", []),
        take(rf"{home}/([a-z]+)/(\d{{4}})/(\d+)", []),
        take(r"european/regulation/(\d{4})/(\d+)", [F.lit("eur")]),
        take(r"european/directive/(\d{4})/(\d+)", [F.lit("eudr")]),
    )


def is_enabling(slash: Column) -> Column:
    return F.split(slash, "/")[0].isin(*ENABLING)


def path_parts(path: Column) -> Column:
    """(type, year, number) of a page path, null if it isn't one of a law."""
    pattern = r"/([a-z]*)/(\d{4})/(\d+)/"
    return F.when(path.rlike(pattern), F.struct(*[F.regexp_extract(path, pattern, i).alias(n) for i, n in ((1, "type_code"), (2, "year"), (3, "number"))]))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
