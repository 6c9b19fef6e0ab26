"""Problem 3 on the register: results per law and the laws that are heavy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandect.functions.keys import law_key
from pandect.functions.text import squeeze_blanks
from pandect.operators.tree_aggregate import tree_aggregate
from pandect.plans.cut import stored

#: A law is heavy from this part of a table's distinct units or annotations.
HEAVY_SHARE = 0.04


def _items(df: DataFrame, table: str, key: str, characters: bool) -> DataFrame:
    """One row per distinct key and law: repeated and revised rows are folded
    together by key, which spreads even the heaviest law over all partitions."""
    size = F.length(squeeze_blanks("text")) if characters else F.lit(0)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), law_key(F.col("law_name")).alias("law_name"), *([size.alias("size"), "updated_at", "synced_at"] if characters else []))
    aggs = [F.collect_set("law_name").alias("laws")]
    if characters:
        when = F.when(F.col("updated_at").isNotNull(), F.struct("updated_at", (-F.unix_micros(F.col("synced_at").cast("timestamp"))).alias("s")))
        aggs.append(F.coalesce(F.max_by("size", when), F.lit(0)).alias("size"))
    one = rows.groupBy("__key").agg(*aggs)
    # A unit without any law still counts among the table's distinct units.
    laws = F.when(F.size("laws") > 0, F.array_sort("laws")).otherwise(F.array(F.lit(None).cast("string")))
    return one.select(F.lit(table).alias("table_name"), F.posexplode(laws).alias("n", "law_name"), *(["size"] if characters else [F.lit(0).alias("size")]))


def totals(units: DataFrame, annotations: DataFrame, characters: bool = True) -> DataFrame:
    """``table_name, law_name, items, characters, share``: per law its distinct
    units or annotations, the characters of their newest texts, and the part of
    the table's distinct items that it holds. Laws are law keys."""
    rows = _items(units, "lat", "section_id", characters).unionByName(_items(annotations, "amendment_annotations", "id", characters))
    one = F.lit(1).cast("bigint")
    states = {"items": (one, "sum"), "characters": (F.col("size").cast("bigint"), "sum"), "distinct_items": (F.when(F.col("n") == 0, one).otherwise(0), "sum")}
    # One row per law, stored: it is read for itself and for the tables' sums.
    per_law = stored(tree_aggregate(rows, ["table_name", "law_name"], states))
    whole = per_law.groupBy("table_name").agg(F.sum("distinct_items").alias("table_items"))
    out = per_law.where(F.col("law_name").isNotNull()).join(whole, "table_name")
    return out.select("table_name", "law_name", "items", "characters", "table_items")


def heavy(units: DataFrame, annotations: DataFrame) -> DataFrame:
    """``table_name, law_name`` of the laws with at least ``HEAVY_SHARE``."""
    t = totals(units, annotations, characters=False)
    return t.where(F.col("items") * 100 >= F.col("table_items") * int(HEAVY_SHARE * 100)).select("table_name", "law_name")


def law_totals(units: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every law of either table with its items, characters and share."""
    t = totals(units, annotations)
    return t.select("table_name", "law_name", "items", "characters", F.round(F.col("items") / F.col("table_items"), 6).alias("share"))
