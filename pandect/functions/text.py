"""Blanks, letters and tokens of all scripts as Catalyst expressions.

Java's ``\\s`` and ``\\w`` know ASCII only; these classes name what Unicode
calls blanks and word characters, so that results don't depend on the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class: every Unicode blank and line end.
BLANK = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Inside of a character class: letters and digits of all scripts and the underscore.
WORD = r"\p{L}\p{N}_"
#: One token: a run of word characters, or a run of what is neither word nor blank.
TOKEN = rf"[{WORD}]+|[^{WORD}{BLANK}]+"


def strip_blanks(c: Column) -> Column:
    """Without the blanks at both ends; null stays null."""
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze_blanks(c: Column) -> Column:
    """Every run of blanks made one space, those at the ends dropped."""
    return F.trim(F.regexp_replace(c, rf"[{BLANK}]+", " "))


def letters(c: Column) -> Column:
    """The letters alone, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))


def token_count(c: Column) -> Column:
    """Word-and-punctuation tokens; a null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def source_key(c: Column) -> Column:
    """A source's name without regard to case and blanks around it."""
    return F.lower(strip_blanks(c))
