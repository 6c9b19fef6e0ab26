"""Reads, facets, queues and summaries of the register."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pandect.functions.keys import law_key
from pandect.operators.filters import all_of, equal_if, search
from pandect.plans.cut import stored
from pandect.plans.newest import newest

#: The statuses of a law as the register labels them. Fixed values.
IN_FORCE, PART_REVOKED, REVOKED = "✔ In force", "⭕ Part Revocation / Repeal", "❌ Revoked / Repealed / Abolished"
#: Families that mark laws without one. Fixed values.
NO_FAMILY = ("_todo", "🖤 X: No Family")


def laws(table: DataFrame, *columns: str) -> DataFrame:
    """The newest row of each law."""
    return newest(table, "name", columns or [c for c in table.columns if c != "record_change_log"])


def units(table: DataFrame, *columns: str) -> DataFrame:
    return newest(table, "section_id", [*columns, "law_name"] if columns else table.columns).withColumn("law_name", law_key(F.col("law_name")))


def annotations(table: DataFrame, *columns: str) -> DataFrame:
    return newest(table, "id", [*columns, "law_name"] if columns else table.columns).withColumn("law_name", law_key(F.col("law_name")))


def optional_search(df: DataFrame, family=None, year=None, type_code=None, status=None, text=None) -> DataFrame:
    return df.where(all_of([equal_if("family", family), equal_if("year", year), equal_if("type_code", type_code), equal_if("live", status), search(["title_en", "number", "name"], text)]))


def screening(df: DataFrame, family=None, geo_extent=None, status: str = IN_FORCE) -> DataFrame:
    """Laws that carry the mark 'Making' at all (whatever its value) and have a status."""
    return df.where(F.map_contains_key("function", F.lit("Making")) & (F.col("live") == status)).where(all_of([equal_if("family", family), equal_if("geo_extent", geo_extent)]))


def marked(df: DataFrame, family: str, mark: str, type_code=None) -> DataFrame:
    """Laws of a family whose mark is true: another predicate than its presence."""
    return df.where((F.col("family") == family) & (F.col("function")[mark] == F.lit(True))).where(all_of([equal_if("type_code", type_code)]))


def amended_within(df: DataFrame, column: str, as_of: str, months: int = 12) -> DataFrame:
    return df.where(F.col(column) > F.add_months(F.lit(as_of).cast("date"), -months))


def present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(F.col("name").isin(list(names)))


def missing(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return wanted.join(df.select(key), key, "left_anti")


def display_name(name: str = "name", title: str = "title_en", id_: str = "id") -> Column:
    return F.coalesce(F.col(name), F.col(title), F.concat(F.lit("Record #"), F.coalesce(F.col(id_), F.lit(""))))


def title_with_year(title: str = "title_en", year: str = "year") -> Column:
    """A missing part is left empty; the brackets stay."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" ("), F.coalesce(F.col(year).cast("string"), F.lit("")), F.lit(")"))


def facet(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Distinct values; the order is a property of the page, not of the set."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def table_stats(unit_rows: DataFrame, annotation_rows: DataFrame) -> DataFrame:
    """One row: rows and distinct laws of both tables, from one pass each."""
    tagged = unit_rows.select(F.lit("u").alias("t"), law_key(F.col("law_name")).alias("law")).unionByName(annotation_rows.select(F.lit("a").alias("t"), law_key(F.col("law_name")).alias("law")))
    per = tagged.groupBy("t", "law").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda t, v: F.coalesce(F.sum(F.when(F.col("t") == t, v)), F.lit(0))
    one = F.when(F.col("law").isNotNull(), 1).otherwise(0)
    return per.agg(pick("u", F.col("n")).alias("total_units"), pick("u", one).alias("laws_with_units"), pick("a", F.col("n")).alias("total_annotations"), pick("a", one).alias("laws_with_annotations"))


def unit_stats(unit_rows: DataFrame) -> DataFrame:
    return unit_rows.where(F.col("law_id").isNotNull()).groupBy("law_id").agg(F.count(F.lit(1)).alias("unit_count"), F.max("updated_at").alias("latest_unit"))


def work_queue(law_rows: DataFrame, unit_rows: DataFrame, reason: str | None = None) -> DataFrame:
    """Laws that make rules and whose units are missing, or stale by six
    calendar months: the laws joined with pre-aggregated units."""
    chosen = law_rows.where((F.col("function")["Making"] == F.lit(True)) & F.col("title_en").isNotNull() & F.col("family").isNotNull() & ~F.col("family").isin(*NO_FAMILY))
    joined = chosen.join(unit_stats(unit_rows), chosen["id"] == F.col("law_id"), "left")
    n = F.coalesce("unit_count", F.lit(0))
    stale = F.col("updated_at") > F.col("latest_unit") + F.expr("INTERVAL 6 MONTHS")
    kind = F.when(n == 0, "missing").when(stale, "stale")
    out = joined.withColumn("queue_reason", kind).where(F.col("queue_reason").isNotNull())
    out = out.select(F.col("id").alias("law_id"), F.col("name").alias("law_name"), "title_en", "year", "type_code", "family", "live", F.map_keys("function").alias("marks"), F.col("updated_at").alias("law_updated_at"), n.alias("unit_count"), F.col("latest_unit").alias("latest_unit_updated_at"), "queue_reason")
    return out if reason is None else out.where(F.col("queue_reason") == reason)


def queue_from_counts(law_rows: DataFrame, days: int = 180) -> DataFrame:
    """The queue as a client derives it from counts kept with each law
    (``unit_count``, ``latest_unit``): stale after fixed days, whatever the law does."""
    n = F.coalesce("unit_count", F.lit(0))
    stale = F.col("updated_at") > F.col("latest_unit") + F.make_dt_interval(F.lit(days))
    return law_rows.withColumn("queue_reason", F.when(n == 0, "missing").when(stale, "stale")).where(F.col("queue_reason").isNotNull())


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("queue_reason") == "missing").alias("missing_count"), F.count_if(F.col("queue_reason") == "stale").alias("stale_count"))


def law_summary(law_rows: DataFrame, unit_rows: DataFrame, annotation_rows: DataFrame, text: str | None = None, type_code: str | None = None) -> DataFrame:
    """Laws with units, their numbers of units and annotations. Both sides are
    aggregated before they are joined, so only one row per law is."""
    u = unit_rows.groupBy("law_name", "law_id").agg(F.count("section_id").alias("unit_count"))
    a = annotation_rows.groupBy("law_name").agg(F.count(F.lit(1)).alias("annotation_count"))
    joined = u.join(law_rows.select(F.col("id").alias("law_id"), "title_en", "year", "type_code"), "law_id").join(a, "law_name", "left")
    joined = joined.where(all_of([search(["title_en", "law_name"], text), equal_if("type_code", type_code)]))
    return joined.select("law_name", "law_id", "title_en", "year", "type_code", "unit_count", F.coalesce("annotation_count", F.lit(0)).alias("annotation_count"))


def changed_since(rows: DataFrame, law_rows: DataFrame, since: str, names: Sequence[str] | None = None) -> DataFrame:
    """Incremental pull: rows from a time on, with their law's title, type and year."""
    new = rows.where(F.col("updated_at") >= F.lit(since).cast("timestamp_ntz"))
    if names is not None:
        new = new.where(F.col("law_name").isin(list(names)))
    law = law_rows.select(F.col("id").alias("law_id"), F.col("title_en").alias("law_title"), F.col("type_code").alias("law_type_code"), F.col("year").alias("law_year"))
    return new.join(law, "law_id")


def entries_queue(entry_rows: DataFrame, threshold: float) -> DataFrame:
    """Entries whose confidence is unknown or below a threshold."""
    return entry_rows.where(F.col("confidence").isNull() | (F.col("confidence") < threshold)).select("law_name", F.col("field").alias("source_column"), F.col("entry_no").alias("entry_index"), F.col("article").alias("provision"), F.lower("duty_type").alias("kind"), F.col("item").alias("holder"), "clause", "confidence")


#: Stretches of values per group in which exact ranks are counted separately.
RANK_STRETCHES = 64


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[int]) -> DataFrame:
    """Percentiles at the nearest lower rank, ``trunc(p / 100 * (n - 1))`` of the
    sorted values, with least and greatest.

    Approximate quantiles cut every group into stretches of about equal size;
    they only place the cuts. Exact counts of the stretches lead to the one that
    holds a rank, and values are ranked within their stretch, so no task sorts
    a whole group.
    """
    rows = df.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    at = F.array(*[F.lit(i / RANK_STRETCHES) for i in range(1, RANK_STRETCHES)])
    names = [f"__k{i}" for i in range(len(keys))]
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    cuts = stored(rows.groupBy(*renamed).agg(F.percentile_approx("__v", at, F.lit(1_000)).alias("__cuts")))
    placed = rows.join(cuts, same).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))))
    counted = placed.groupBy(*keys, "__b", "__v").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*names).orderBy("__bb")
    sums = counted.groupBy(*renamed, F.col("__b").alias("__bb")).agg(F.sum("__n").alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__sum").over(Window.partitionBy(*names)))
    run = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("__in", F.sum("__n").over(run)).join(sums, same & (F.col("__b") == F.col("__bb"))).withColumn("__upto", F.col("__before") + F.col("__in"))
    rank = lambda p: F.floor(F.lit(p) / 100 * (F.col("__all") - 1))
    hit = lambda p: F.max(F.when((F.col("__upto") - F.col("__n") <= rank(p)) & (rank(p) < F.col("__upto")), F.col("__v"))).alias(f"p{p}")
    return ranked.groupBy(*keys).agg(*[hit(p) for p in points], F.min("__v").alias("least"), F.max("__v").alias("greatest"), F.max("__all").alias("n"))
