"""Lists of work on the register: records grouped in sessions, and cascades of
laws that a change reaches, read, counted, merged and summed up.

What statuses there are and which may follow which is a parameter; nothing here
knows a workflow.

Cases: null keys are left out of merges; an update that repeats a key counts
once, by its order; a session without entries has counts of 0; entries without
source laws have none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_status(df: DataFrame, *statuses: str) -> DataFrame:
    return df.where(F.col("status").isin(*statuses))


def recent(df: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` latest rows; a sort with a limit keeps ``n`` rows per task."""
    return df.orderBy(F.col(at).desc_nulls_last(), *ties).limit(n)


def selected_in_group(df: DataFrame, group: str) -> DataFrame:
    return df.where((F.col("group") == group) & F.coalesce(F.col("selected"), F.lit(False)))


def layered(entries: DataFrame) -> DataFrame:
    """Entries with their ``place`` in their session: by layer (unknown last), kind and law."""
    w = Window.partitionBy("session_id").orderBy(F.col("layer").asc_nulls_last(), "update_type", "affected_law")
    return entries.withColumn("place", F.row_number().over(w))


def sessions_with_pending(entries: DataFrame) -> DataFrame:
    return entries.where("status = 'pending'").groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"))


def session_stats(sessions: DataFrame, entries: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Per session its entries, those of each kind, and those still pending."""
    per = entries.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(F.col("update_type") == k).alias(k) for k in kinds], F.count_if(F.col("status") == "pending").alias("pending"))
    return sessions.join(per, "session_id", "left").na.fill(0, ["entries", *kinds, "pending"])


def cascade_summary(entries: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Per session the least layer, entries per status, and how many different
    laws they come from."""
    per = entries.groupBy("session_id").agg(F.min("layer").alias("first_layer"), F.count_distinct("layer").alias("layers"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    sources = entries.select("session_id", F.explode("source_laws").alias("law")).distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("source_laws"))
    return per.join(sources, "session_id", "left").na.fill(0, ["source_laws"])


def layer_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("session_id", "layer").agg(F.count(F.lit(1)).alias("entries"))


def counts_by_status(records: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Records per group, one column per status."""
    return records.groupBy("group").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def with_source(stored: DataFrame, landed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of a table, and of files those whose key the table lacks, with where they are from."""
    rest = landed.join(stored.select(*key).distinct(), list(key), "left_anti")
    return stored.withColumn("source", F.lit("table")).unionByName(rest.withColumn("source", F.lit("file")))


def entries_of_lists(sessions: DataFrame, lists: Mapping[str, str]) -> DataFrame:
    """Entries from a session's lists of laws: ``lists`` maps a column to the
    kind of update its laws get; all lists in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("update_type"), F.col(c).alias("laws")) for c, k in lists.items()])
    one = sessions.select("session_id", F.inline(cells))
    return one.select("session_id", "update_type", F.explode("laws").alias("affected_law")).where("affected_law <> ''").distinct()


def transitions(state: DataFrame, updates: DataFrame, key: Sequence[str], allowed: Mapping[str, Sequence[str]], order: str) -> tuple[DataFrame, DataFrame]:
    """(state after the updates, refused updates): an update of a known key must
    go from its ``status`` to one that may follow; a new key may begin with any.
    Of several updates of a key the last in ``order`` counts."""
    for k in key:
        updates = updates.where(F.col(k).isNotNull())
    last = updates.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc(), "status"))).where("__r = 1").select(*key, F.col("status").alias("__to"))
    both = state.select(*key, "status").join(last, list(key), "full_outer")
    may = [F.col("status").eqNullSafe(F.lit(a)) & F.col("__to").isin(list(b)) for a, b in allowed.items()]
    legal: Column = F.col("status").isNull()
    for m in may:
        legal = legal | m
    legal = legal & F.col("__to").isNotNull()
    after = both.select(*key, F.when(legal, F.col("__to")).otherwise(F.col("status")).alias("status"))
    return after, both.where(F.col("__to").isNotNull() & ~legal).select(*key, "status", F.col("__to").alias("refused"))


def mark(entries: DataFrame, which: Column, status: str) -> DataFrame:
    """Entries with those that ``which`` holds for set to a status."""
    return entries.withColumn("status", F.when(F.coalesce(which, F.lit(False)), status).otherwise(F.col("status")))


def results_per_item(items: DataFrame, value: Column, error: str) -> DataFrame:
    """Items with a result, or the error where there is none: a batch that goes
    on over what fails."""
    return items.withColumn("result", value).withColumn("error", F.when(F.col("result").isNull(), error))


def days(first: str, last: str, pages: DataFrame, day: str) -> DataFrame:
    """Landed rows of each day of a range, days without any skipped; the bounds
    go to the scan, the range itself is made of two literals."""
    spark = pages.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("__day"))
    inside = pages.where(F.col(day).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return inside.join(wanted, F.col(day) == F.col("__day")).drop("__day")


def enriched(listing: DataFrame, metadata: DataFrame, key: str, title: str, fields: Sequence[str]) -> DataFrame:
    """A listing with fields of the metadata; its own title stays unless empty."""
    extra = metadata.select(key, F.col(title).alias("__title"), *fields)
    joined = listing.join(extra, key, "left")
    return joined.withColumn(title, F.coalesce(F.nullif(F.trim(F.col(title)), F.lit("")), F.col("__title"))).drop("__title")


def renamed(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Fields from the first of their aliases that a row fills; aliases that no column has are passed over."""
    have = set(df.columns)
    return df.select(*[F.coalesce(*[F.col(a) for a in names if a in have], F.lit(None)).alias(n) for n, names in aliases.items()])


def split_on(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which a flag holds, all others)."""
    held = F.coalesce(flag, F.lit(False))
    return df.where(held), df.where(~held)


def array_of(text: Column) -> Column:
    """Comma-separated text as an array; null for null or empty text."""
    return F.split(F.nullif(text, F.lit("")), ",")


def text_of(values: Column) -> Column:
    """An array as comma-separated text; null stays null."""
    return F.array_join(values, ",")


def for_insert(units: DataFrame, law_id: Column, now: Column) -> DataFrame:
    """Units as they are inserted: counts that aren't known are 0, language and times are set."""
    counts = ["amendment_count", "modification_count", "commencement_count", "extent_count", "editorial_count"]
    return units.select("section_id", "law_name", law_id.alias("law_id"), "section_type", "sort_key", "position", "depth", "text", F.coalesce("language", F.lit("en")).alias("language"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], now.alias("created_at"), now.alias("updated_at"))


def compared(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the value of two periods and the change in per cent, to one decimal."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    change = F.when(F.col("before") != 0, F.round((F.col("after") - F.col("before")) * 100.0 / F.col("before"), 1))
    return a.join(b, key, "full_outer").withColumn("change_pct", change)


def strategies(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """How many rows each of several tests is the first to decide, and how many none does."""
    first = F.coalesce(*[F.when(c, n) for n, c in tests.items()], F.lit("none"))
    return df.groupBy(first.alias("strategy")).agg(F.count(F.lit(1)).alias("rows"))


def scoped(df: DataFrame, tenant: str, column: str, asked: Column | None = None) -> DataFrame:
    """A shape of one tenant: what was asked for can only narrow it."""
    own = F.col(column) == F.lit(tenant)
    return df.where(own if asked is None else own & F.coalesce(asked, F.lit(False)))


def answer(tables: Mapping[str, DataFrame], expression: str, key_columns: Mapping[str, str]) -> DataFrame:
    """Rows for a key expression ``table/key`` (``table/*`` gives all) as one JSON text each."""
    name, _, key = expression.partition("/")
    rows = tables[name] if key == "*" else tables[name].where(F.col(key_columns[name]) == key)
    return rows.select(F.col(key_columns[name]).alias("key"), F.to_json(F.struct(*[c for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def domain_of(family: Column, domains: Mapping[str, str]) -> Column:
    """Domain of a family by the first beginning of its name that is known, null if none is."""
    return F.coalesce(*[F.when(F.startswith(F.ltrim(family), F.lit(start)), F.lit(d)) for start, d in domains.items()])


def replaced(state: DataFrame, rows: DataFrame, column: str, value: str) -> DataFrame:
    """A table with all rows of one value of a column replaced by others."""
    return state.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(rows.select(*state.columns))
