"""Titles of laws: classes, types, acronyms, tags, cleaning, dates in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pandect.functions.citations import lookup

# The word that ends a title, and the class of law it stands for, in order of precedence.
CLASSES = (
    ("Act", "Act"),
    ("Regulations?", "Regulation"),
    ("Order", "Order"),
    ("Rules?", "Rules"),
    ("Scheme", "Scheme"),
    ("Confirmation Instrument", "Confirmation Instrument"),
    ("Bye-?laws", "Byelaws"),
    ("Measure", "Measure"),
)
# Codes of types of law and their names.
TYPES = {
    "ukpga": "Public General Act of the United Kingdom Parliament",
    "uksi": "UK Statutory Instrument",
    "ukla": "UK Local Act",
    "ukmo": "UK Ministerial Order",
    "ukci": "Church Instrument",
    "asp": "Act of the Scottish Parliament",
    "ssi": "Scottish Statutory Instrument",
    "nisr": "Northern Ireland Statutory Rule",
    "nisi": "Northern Ireland Order in Council 1972-date",
    "nia": "Act of the Northern Ireland Assembly",
    "wca": "Act of the National Assembly for Wales",
    "asc": "Act of the Senedd Cymru 2020-date",
    "anaw": "Act of the National Assembly for Wales 2012-2020",
    "wsi": "Wales Statutory Instrument 2018-date",
    "mwa": "Measure of the National Assembly for Wales 2008-2011",
    "eur": "EU Retained Legislation",
    "eudr": "EU Directive",
    "eudn": "EU Decision",
}
# Words that are no tags.
STOP_WORDS = "the a an and at are as to this that these those for or of off on if in is it its no not be by who with has have".split()
# Marks in a title and the purpose they give away, in order of precedence.
TITLE_PURPOSES = (
    (r"\(Revocation\)|\(Repeal\)", "Repeal+Revocation"),
    (r"\(Commencement", "Enactment+Citation+Commencement"),
    (r"\(Application\)", "Application+Scope"),
    (r"\(Transitional", "Transitional Arrangement"),
    (r"\(Extent\)|\(Extension", "Extent"),
)
# Month names in order.
MONTHS = "january february march april may june july august september october november december".split()


def type_class(title: Column) -> Column:
    """Class of law by the word before the year at the title's end."""
    out = F.when(title.rlike(r"Regulation \(EU\)|Council Directive"), "EU")
    for word, name in CLASSES:
        out = out.when(title.rlike(rf"{word}(?:\s+\d{{4}})?(?:\s+\(Northern Ireland\))?[ ]?$"), name)
    return out


def type_name(code: Column) -> Column:
    return lookup(TYPES, code)


def acronym(title: Column) -> Column:
    """The capitals of a title without its leading article."""
    return F.regexp_replace(F.regexp_replace(title, "^The ", ""), "[^A-Z]", "")


def tags(title: Column) -> Column:
    """Capitalised words of a title, without digits, marks and stop words."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z\s:]+", ""), r"\s+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))


def clean_title(title: Column) -> Column:
    """Without article, marks of repeal and year; odd blanks become plain ones."""
    t = F.regexp_replace(F.regexp_replace(title, "\\x{a0}", " "), "^The ", "")
    for pattern in (r" \(repealed \d+\.\d+\.\d{4}\)$", r" \(repealed\)$", r" \(revoked\)$", r"[ |]\d{4}$"):
        t = F.regexp_replace(t, pattern, "")
    return t


def split_title(title: Column) -> Column:
    """What follows the first " - ", or all of it."""
    rest = F.regexp_extract(title, "^.*? - (.*)$", 1)
    return F.when(title.contains(" - "), rest).otherwise(title)


def title_purpose(title: Column) -> Column:
    """Purpose that a title gives away, null without."""
    out = F.when(title.rlike(r"\(Amendment"), "Amendment")
    for pattern, purpose in TITLE_PURPOSES:
        out = out.when(title.rlike(pattern), purpose)
    return out


def title_status(title: Column) -> Column:
    """Status that a mark of revocation or repeal in a title means, null without."""
    gone = title.rlike(r"(?i)\((?:revoked|repealed)[^)]*\)")
    part = title.rlike(r"(?i)\((?:revoked|repealed)[^)]*in part[^)]*\)|\(partially (?:revoked|repealed)")
    return F.when(part, "⭕ Part Revocation / Repeal").when(gone, "❌ Revoked / Repealed / Abolished")


def date_in_words(text: Column) -> Column:
    """ISO form of dates such as "at 3.32 p.m. on 10th September 2020"; text
    that has a hyphen is taken to be one already; null if unreadable."""
    t = F.regexp_replace(text, r"\p{Punct}", "")
    for pattern, by in ((r"^.*?on ", ""), (r"at.*$", ""), (r"^.*?pm ", ""), (r"([a-z])(\d{4})$", "$1 $2"), (r"(st|nd|rd|th)([A-Z])", "$1 $2")):
        t = F.regexp_replace(t, pattern, by)
    parts = r"^\s*\d*?(\d{1,2})\D*\s+([A-Za-z]+)\s+(\d{4})\s*$"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(t, parts, 2)))
    made = F.format_string("%s-%02d-%02d", F.regexp_extract(t, parts, 3), month, F.nullif(F.regexp_extract(t, parts, 1), F.lit("")).cast("int"))
    return F.when(text == "", F.lit(None)).when(text.contains("-"), text).when(t.rlike(parts) & (month > 0), made)
