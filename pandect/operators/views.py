"""Saved views: columns, calendar filters, status filters, order and grouping.

Views are data; ``build`` turns one into a frame. Dates are relative to
``as_of``, so a view is reproducible.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandect.operators.filters import all_of, OPERATORS
from pandect.operators.register import IN_FORCE, PART_REVOKED, REVOKED, counts_by


def calendar(as_of: str) -> dict[str, dt.date]:
    """Starts of the current and last month, quarter and year, and of the year
    three years back."""
    d = dt.date.fromisoformat(as_of)
    month, quarter, year = d.replace(day=1), d.replace(month=(d.month - 1) // 3 * 3 + 1, day=1), d.replace(month=1, day=1)
    back = lambda x, n: (x.replace(day=1) - dt.timedelta(days=1)).replace(day=1) if n == 1 else back(back(x, 1), n - 1)
    return {"today": d, "this_month": month, "last_month": back(month, 1), "this_quarter": quarter, "last_quarter": back(quarter, 3), "this_year": year, "last_year": year.replace(year=year.year - 1), "last_3_years": year.replace(year=year.year - 3)}


@dataclass(frozen=True)
class View:
    date: str | None
    start: str | None = None
    end: str | None = None
    statuses: tuple[str, ...] = ()
    group: tuple[str, ...] = ()
    columns: tuple[str, ...] = field(default=("name", "title_en", "type_code", "live", "family"))


_PERIODS = {"this_month": None, "last_month": "this_month", "this_quarter": None, "last_quarter": "this_quarter", "this_year": None, "last_year": "this_year", "last_3_years": "today"}


def _dated(prefix: str, column: str, statuses: tuple[str, ...]) -> dict[str, View]:
    return {f"{prefix}_{p}": View(column, p, end, statuses, (f"{column}_year", f"{column}_month")) for p, end in _PERIODS.items()}


VIEWS: dict[str, View] = {
    **_dated("new", "md_date", ()),
    **_dated("amended", "latest_amend_date", (IN_FORCE, PART_REVOKED)),
    **_dated("repealed", "latest_rescind_date", (REVOKED,)),
    "by_family": View(None, group=("family",)),
    "by_status": View(None, group=("live",)),
    "by_type": View(None, group=("type_code",)),
    "by_extent": View(None, group=("geo_extent",)),
}


def build(df: DataFrame, name: str, as_of: str) -> DataFrame:
    """The rows of a view, newest first. Both ends of a period are exclusive:
    the first day of a period is not in it."""
    v, at = VIEWS[name], calendar(as_of)
    parts = []
    if v.date:
        parts.append(OPERATORS["is_after"](v.date, at[v.start]))
        if v.end:
            parts.append(OPERATORS["is_before"](v.date, at[v.end]))
    if v.statuses:
        parts.append(OPERATORS["in"]("live", v.statuses))
    out = df.where(all_of(parts))
    extra = [v.date, F.year(v.date).alias(f"{v.date}_year"), F.month(v.date).alias(f"{v.date}_month")] if v.date else [g for g in v.group if g not in v.columns]
    out = out.select(*v.columns, *extra)
    return out.orderBy(F.col(v.date).desc_nulls_first(), "name") if v.date else out.orderBy("name")


def grouped(df: DataFrame, name: str, as_of: str) -> DataFrame:
    """Counts of a view's rows by its grouping columns."""
    return counts_by(build(df, name, as_of), *VIEWS[name].group)
