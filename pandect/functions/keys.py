"""Law keys: one normal form ``UK_{type}_{year}_{number}`` for all spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pandect.functions.text import strip_blanks

#: type, year and number at the end of a reference, whatever stands between and before them.
LAW_PARTS = r"([a-z]+)[^a-z0-9]+(\d{4})[^a-z0-9]+(\d+)[^a-z0-9]*$"


#: A year and a number without type, and a type and a year without number, at the end of a reference.
_NO_TYPE = r"(?:^|[^a-z0-9])(\d{4})[^a-z0-9]+(\d+)[^a-z0-9]*$"
_NO_NUMBER = r"([a-z]+)[^a-z0-9]+(\d{4})[^a-z0-9]*$"


def _match(low: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(low, pattern, i), F.lit(""))


def law_parts(c: Column) -> tuple[Column, Column, Column]:
    """(type, year, number) of a law reference, each read for itself: a
    reference that lacks its type or its number gives the other two; a part that
    can't be read is null."""
    low = F.lower(c)
    kind, year, number = (_match(low, LAW_PARTS, i) for i in (1, 2, 3))
    whole = low.rlike(LAW_PARTS)
    bare = low.rlike(_NO_TYPE)
    return (
        F.when(whole, kind).when(~bare, _match(low, _NO_NUMBER, 1)),
        F.when(whole, year).when(bare, _match(low, _NO_TYPE, 1)).otherwise(_match(low, _NO_NUMBER, 2)),
        F.when(whole, number).when(bare, _match(low, _NO_TYPE, 2)),
    )


def law_key(c: Column) -> Column:
    """Normal form of a law reference; text without type, year and number is
    only stripped, and null or blank text gives null."""
    kind, year, number = (_match(F.lower(c), LAW_PARTS, i) for i in (1, 2, 3))
    return F.coalesce(F.concat(F.lit("UK_"), kind, F.lit("_"), year, F.lit("_"), number), F.nullif(strip_blanks(c), F.lit("")))
