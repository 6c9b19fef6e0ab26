"""Positions, sequence numbers, repeated keys and parallel provisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", stretch: Column | None = None) -> DataFrame:
    """1-based number of each row within its keys.

    ``stretch`` is a coarse value that rises with the order (such as the first
    digits of a sort key): then rows are numbered within stretches, and
    stretches by their counts, so no task needs all rows of a heavy key.
    """
    if stretch is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = df.withColumn("__s", stretch)
    inside = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(*order))
    along = Window.partitionBy(*[F.col(f"__k{i}") for i in range(len(keys))]).orderBy(F.col("__t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__s").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__s").eqNullSafe(F.col("__t"))]
    out = rows.withColumn("__i", inside).join(counts, same)
    return out.select(*df.columns, (F.col("__i") + F.col("__before")).cast("int").alias(name))


def disambiguated(df: DataFrame, key: str, position: str) -> DataFrame:
    """Keys that occur more than once get ``#position`` behind them."""
    often = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.count(F.lit(1)) > 1).alias("__often")).where("__often")
    out = df.join(often, F.col(key) == F.col("__key"), "left")
    return out.select(*df.columns, F.when(F.col("__often"), F.concat(F.col(key), F.lit("#"), F.col(position).cast("string"))).otherwise(F.col(key)).alias("unique_key"))


def parallel(df: DataFrame, keys: Sequence[str], extent: str) -> DataFrame:
    """Provisions that have more than one extent, with how many."""
    rows = df.where(F.col(extent).isNotNull() & (F.col(extent) != ""))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull() & (F.col(k) != ""))
    pairs = rows.select(*keys, extent).distinct()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("extents")).where("extents > 1")


def inverted(df: DataFrame, key: str, refs: str, order: str) -> DataFrame:
    """Reference to its distinct keys, in order of their first occurrence."""
    one = df.select(key, order, F.explode(refs).alias("ref")).groupBy("ref", key).agg(F.min(order).alias("__o"))
    return one.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", key))), lambda x: x[key]).alias("keys"))


def inherited(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, stretch: Column | None = None) -> DataFrame:
    """The last value given at or before each row, as headings apply to what
    follows; ``stretch`` as in ``numbered``: the last value of the stretches
    before carries over."""
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if stretch is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(upto(*keys)))
    rows = df.withColumn("__s", stretch)
    inside = F.last(value, ignorenulls=True).over(upto(*keys, "__s"))
    place = F.struct(*[F.struct(F.col(o).isNotNull().alias("a"), F.col(o).alias("b")) for o in order])
    ends = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__s").alias("__t")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("__last"))
    along = Window.partitionBy(*[F.col(f"__k{i}") for i in range(len(keys))]).orderBy(F.col("__t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carried", F.last("__last", ignorenulls=True).over(along)).drop("__last")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__s").eqNullSafe(F.col("__t"))]
    return rows.withColumn("__in", inside).join(ends, same).select(*df.columns, F.coalesce("__in", "__carried").alias(name))


def merged_ranges(df: DataFrame, keys: Sequence[str], start: str, end: str, span: float | None = None) -> DataFrame:
    """Overlapping or touching ranges made one. With ``span`` the ranges of a key
    are merged in stretches of so much of ``start``: how far the stretches before
    reach, and how many merged ranges they begin, carries over."""
    rows = df.withColumn("__s", F.lit(0).cast("bigint") if span is None else F.floor(F.col(start) / F.lit(span)).cast("bigint"))
    other = [f"__k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(o) for k, o in zip(keys, other, strict=True)]
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)] + [F.col("__s").eqNullSafe(F.col("__t"))]
    inside = Window.partitionBy(*keys, "__s").orderBy(start, end)
    along = Window.partitionBy(*other).orderBy(F.col("__t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*named, F.col("__s").alias("__t")).agg(F.max(end).alias("__end"))
    ends = ends.withColumn("__carried", F.max("__end").over(along)).drop("__end")
    reach = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carried"))
    marked = rows.join(ends, same).drop(*other, "__t").withColumn("__fresh", F.when(F.coalesce(F.col(start) > reach, F.lit(True)), 1).otherwise(0))
    marked = marked.withColumn("__n", F.sum("__fresh").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    begun = marked.groupBy(*named, F.col("__s").alias("__t")).agg(F.sum("__fresh").alias("__sum"))
    begun = begun.withColumn("__before", F.coalesce(F.sum("__sum").over(along), F.lit(0))).drop("__sum")
    out = marked.join(begun, same).withColumn("__island", F.col("__before") + F.col("__n"))
    return out.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
