"""Differences of records, change logs, and merges by key.

There is no transactional table format here: a merge gives the new state as a
frame, to be written to a new place and swapped in; nothing overwrites what
it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandect.functions.citations import filled
from pandect.functions.text import strip_blanks


def blank_to_null(c: Column, kind: str) -> Column:
    """Empty text, arrays and maps count as no value."""
    if kind == "string":
        return filled(strip_blanks(c))
    if kind.startswith(("array", "map")):
        return F.when(F.size(c) > 0, c)
    return c


def _text(c: Column, kind: str) -> Column:
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")


def changed_fields(df: DataFrame, fields: Sequence[str], old: str = "old_") -> Column:
    """Map of the fields whose value differs to its old and new text; values
    that are both empty don't differ."""
    kinds = dict(df.dtypes)
    pairs = []
    for f in fields:
        a, b = blank_to_null(F.col(old + f), kinds[f]), blank_to_null(F.col(f), kinds[f])
        x, y = _text(a, kinds[f]), _text(b, kinds[f])
        pairs.append(F.struct(F.lit(f).alias("key"), F.struct(x.alias("old"), y.alias("new")).alias("value")))
    differs = lambda p: ~p["value"]["old"].eqNullSafe(p["value"]["new"])
    return F.map_from_entries(F.filter(F.array(*pairs), differs))


def kind_of_change(old: Column, new: Column) -> Column:
    return F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "removed").when(~old.eqNullSafe(new), "changed")


def summary(changes: Column) -> Column:
    """``Updated 2 fields: a, b``."""
    names = F.array_sort(F.map_keys(changes))
    word = F.when(F.size(changes) == 1, "field").otherwise("fields")
    return F.when(F.size(changes) > 0, F.concat(F.lit("Updated "), F.size(changes).cast("string"), F.lit(" "), word, F.lit(": "), F.array_join(names, ", "))).otherwise("No changes")


def log_entry(changes: Column, at: Column, source: str, by: str) -> Column:
    """Log entry of a change, null if nothing changed."""
    entry = F.struct(at.cast("string").alias("timestamp"), F.lit(source).alias("source"), F.lit(by).alias("changed_by"), summary(changes).alias("summary"), changes.alias("changes"))
    return F.when(F.size(changes) > 0, entry)


def appended(log: Column, entry: Column) -> Column:
    return F.when(entry.isNull(), F.coalesce(log, F.array())).otherwise(F.concat(F.coalesce(log, F.array()), F.array(entry)))


def log_summary(log: Column) -> Column:
    n = F.size(log)
    since = F.substring(F.get(log, F.lit(0))["timestamp"], 1, 10)
    return F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " update since ").otherwise(" updates since "), F.coalesce(since, F.lit("")))).otherwise("No change history")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Field-wise merge of two states with one row per key.

    ``overwrite_non_empty``: a value that ``new`` has wins; ``fill_missing``: a
    value that ``old`` has wins and ``new`` only fills gaps. Maps are united
    either way, the winner's entries first. Keys of one side alone are kept.
    """
    if mode not in ("overwrite_non_empty", "fill_missing"):
        raise ValueError(mode)
    kinds = dict(old.dtypes)
    fields = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in fields])
    n = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in fields])

    def pick(c: str) -> Column:
        a, b = F.col(f"__new_{c}"), F.col(f"__old_{c}")
        first, second = (a, b) if mode == "overwrite_non_empty" else (b, a)
        if kinds[c].startswith("map"):
            rest = F.map_filter(second, lambda k, v: ~F.coalesce(F.map_contains_key(first, k), F.lit(False)))
            return F.when(a.isNotNull() & b.isNotNull(), F.map_concat(first, rest)).otherwise(F.coalesce(a, b))
        return F.coalesce(blank_to_null(first, kinds[c]), blank_to_null(second, kinds[c]))

    return o.join(n, list(keys), "full_outer").select(*keys, *[pick(c).alias(c) for c in fields])


def replace_groups(old: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """Delete-and-insert: groups that ``new`` has are replaced as a whole."""
    return upsert(old, new, group)


def without_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def mark(df: DataFrame, column: str, where: Column, value) -> DataFrame:
    """Bulk update of one column."""
    return df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))


def prepended(old: Column, new: Column) -> Column:
    """New elements that ``old`` lacks, before it."""
    a, b = F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))
    return F.concat(F.array_except(b, a), a)


def as_values(c: Column) -> Column:
    """An array as ``{"values": [...]}``."""
    return F.when(c.isNotNull(), F.struct(c.alias("values")))


def as_marks(c: Column) -> Column:
    """An array as a map of true marks."""
    names = F.array_compact(F.array_distinct(c))
    return F.map_from_arrays(names, F.transform(names, lambda _: F.lit(True)))


def from_marks(c: Column) -> Column:
    """The sorted names that a map marks true."""
    return F.array_sort(F.map_keys(F.map_filter(c, lambda k, v: v)))


def split_by_membership(c: Column, members: Sequence[str]) -> tuple[Column, Column]:
    """One array as those in a vocabulary and those not."""
    return F.filter(c, lambda x: x.isin(*members)), F.filter(c, lambda x: ~x.isin(*members))


def as_document(entries: Column, name: str, names: str) -> Column:
    """Entries as ``{entries, names, articles}`` with sorted distinct lists."""
    pick = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform(entries, lambda e: e[f]), lambda x: x.isNotNull())))
    return F.struct(entries.alias("entries"), pick(name).alias(names), pick("article").alias("articles"))
