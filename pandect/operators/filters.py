"""Optional predicates, generic filter lists, pages and shapes.

Arguments are resolved in Python, so Catalyst sees plain predicates that it
can push down; an absent argument leaves no trace in the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(predicates: Iterable[Column | None]) -> Column:
    """Conjunction of those that are given; true if none is."""
    given = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def equal_if(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def like_anywhere(column: str, text: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` keep their meaning as wildcards."""
    return F.col(column).ilike(f"%{text}%")


def search(columns: Sequence[str], text: str | None) -> Column | None:
    return None if text is None else reduce(lambda a, b: a | b, [like_anywhere(c, text) for c in columns])


#: Operators of a filter list; each maps a column and a value to a predicate.
OPERATORS = {
    "equals": lambda c, v: F.col(c) == F.lit(v),
    "not_equals": lambda c, v: F.col(c) != F.lit(v),
    "contains": lambda c, v: F.col(c).ilike(f"%{v}%"),
    "not_contains": lambda c, v: ~F.col(c).ilike(f"%{v}%"),
    "starts_with": lambda c, v: F.col(c).ilike(f"{v}%"),
    "ends_with": lambda c, v: F.col(c).ilike(f"%{v}"),
    "greater_than": lambda c, v: F.col(c) > F.lit(v),
    "less_than": lambda c, v: F.col(c) < F.lit(v),
    "greater_or_equal": lambda c, v: F.col(c) >= F.lit(v),
    "less_or_equal": lambda c, v: F.col(c) <= F.lit(v),
    "is_empty": lambda c, v: F.col(c).isNull() | (F.col(c).cast("string") == ""),
    "is_not_empty": lambda c, v: F.col(c).isNotNull() & (F.col(c).cast("string") != ""),
    "is_before": lambda c, v: F.col(c) < F.lit(v),
    "is_after": lambda c, v: F.col(c) > F.lit(v),
    "in": lambda c, v: F.col(c).isin(list(v)),
}


def recent_years(column: str, this_year: int) -> Column:
    """The default shape: this year and the two before."""
    return F.col(column) >= F.lit(this_year - 2)


def where_all(filters: Sequence[Mapping], default: Column) -> Column:
    """A list of ``{field, operator, value}`` as one predicate. Unknown
    operators are left out; nothing left gives the default."""
    made = [OPERATORS[f["operator"]](f["field"], f.get("value")) for f in filters if f["operator"] in OPERATORS]
    return all_of(made) if made else default


def shape(df: DataFrame, predicate: Column | str, columns: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Rows of a table that a client may see: its own predicate, and of the
    columns it asks for those on the allow-list."""
    return df.where(predicate).select(*[c for c in columns if c in set(allowed)])


def clamp(value, default: int, most: int, least: int = 0) -> int:
    """A limit or offset as given by a client: bad or negative values become
    the default, too large ones the greatest allowed."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        return default
    return default if number < least else min(number, most)


def fraction(value, default: float) -> float:
    """A threshold between 0 and 1, else the default."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    return number if 0.0 <= number <= 1.0 else default


#: Page sizes (default, greatest) per kind of list. Fixed values.
PAGE_SIZES = {"laws": (50, 100), "units": (500, 5000), "sync": (500, 2000), "entries": (100, 500)}


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; the caller's order must end in a unique key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def has_more(total: int, limit: int, offset: int) -> bool:
    return offset + limit < total


def after(df: DataFrame, keys: Sequence[str], last: Sequence, limit: int) -> DataFrame:
    """Keyset page: the rows that follow the last key seen, in order of the keys."""
    seen = reduce(lambda a, b: a | b, [all_of([F.col(k) == F.lit(v) for k, v in zip(keys[:i], last[:i], strict=True)] + [F.col(keys[i]) > F.lit(last[i])]) for i in range(len(keys))])
    return df.where(seen).orderBy(*keys).limit(limit)
