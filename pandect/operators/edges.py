"""Links between laws: edges, derived dates, labels, cascades, change statistics.

Arrays of references are exploded once into an edge table, so every
membership test becomes an equi-join that can be hashed and spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pandect.functions.citations import filled
from pandect.functions.keys import law_key
from pandect.operators.register import IN_FORCE, PART_REVOKED, REVOKED
from pandect.plans.cut import stored

LAYERS = 3
#: Severity of the statuses. Fixed values.
SEVERITY = {IN_FORCE: 1, PART_REVOKED: 2, REVOKED: 3}


def edges(laws: DataFrame, kinds: Sequence[str], name: str = "name") -> DataFrame:
    """``src, dst, kind``: each referenced law of each list once, as law keys.
    One scan serves all lists."""
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.transform(k, law_key)).alias("to")) for k in kinds])
    return laws.select(F.col(name).alias("src"), F.inline(lists)).select("src", F.explode("to").alias("dst"), "kind").where(F.col("dst").isNotNull())


def latest_related_date(laws: DataFrame, kind: str, date: str = "md_date", only: DataFrame | None = None) -> DataFrame:
    """``name, latest``: per law the greatest date of the laws in one of its
    lists; null without any. ``only`` (``name``) limits it to those laws."""
    base = laws if only is None else laws.join(only.select("name").distinct(), "name", "left_semi")
    found = edges(base, [kind]).join(laws.select(F.col("name").alias("dst"), F.col(date).alias("__d")), "dst").groupBy("src").agg(F.max("__d").alias("latest"))
    return base.select("name").join(found.withColumnRenamed("src", "name"), "name", "left")


def latest_date_of(links: DataFrame, laws: DataFrame, name: str, date: str = "md_date") -> DataFrame:
    """``name`` (of ``src``) and the greatest date of the laws it is linked to (``src, dst``)."""
    dated = links.select("src", "dst").distinct().join(laws.select(F.col("name").alias("dst"), F.col(date).alias("__d")), "dst")
    return dated.groupBy(F.col("src").alias("name")).agg(F.max("__d").alias(name))


def with_derived_dates(laws: DataFrame, changes: DataFrame) -> DataFrame:
    """Laws with ``latest_amend_date``, of the laws they say amend them, and
    ``latest_rescind_date``, of the laws whose changes revoke something of them
    (``changes``: ``law_name, item, affect``)."""
    gone = changes.where(is_revocation(F.col("affect")) & (F.col("item") != F.col("law_name"))).select(F.col("law_name").alias("src"), F.col("item").alias("dst"))
    amend = latest_date_of(edges(laws, ["amended_by"]), laws, "latest_amend_date")
    return laws.join(amend, "name", "left").join(latest_date_of(gone, laws, "latest_rescind_date"), "name", "left")


def dependants(laws: DataFrame, changed: DataFrame, kind: str) -> DataFrame:
    """Laws whose list names one of the changed ones: what must be derived anew."""
    hit = edges(laws, [kind]).join(changed.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")
    return hit.select(F.col("src").alias("name")).distinct()


def resolved(laws: DataFrame, kind: str) -> DataFrame:
    """``name, links``: references that exist, sorted; empty where none does."""
    good = edges(laws, [kind]).join(laws.select(F.col("name").alias("dst")), "dst", "left_semi")
    per = good.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("links"))
    return laws.select("name").join(per.withColumnRenamed("src", "name"), "name", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def known_and_unknown(laws: DataFrame, kind: str) -> DataFrame:
    """Referenced laws with the number of referring ones, whether they are in
    the register, and their title if so."""
    per = edges(laws, [kind]).groupBy("dst").agg(F.count_distinct("src").alias("referrers"))
    side = laws.select(F.col("name").alias("dst"), F.col("title_en").alias("title"), F.lit(True).alias("__in"))
    return per.join(side, "dst", "left").select(F.col("dst").alias("name"), "referrers", F.coalesce("__in", F.lit(False)).alias("known"), "title")


def reversed_lists(laws: DataFrame, kind: str, flag: Column) -> DataFrame:
    """Per referenced law its referrers, sorted, and whether any has a flag."""
    pairs = edges(laws, [kind]).join(laws.select(F.col("name").alias("src"), F.coalesce(flag, F.lit(False)).alias("__f")), "src")
    return pairs.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("referrers"), F.bool_or("__f").alias("any_flag")).withColumnRenamed("dst", "name")


def function_labels(laws: DataFrame, relations: Mapping[str, str], making: Column, commencing: Column) -> DataFrame:
    """``name, labels``: a law's own marks, and per relation whether it reaches
    laws that make rules ("X Maker") and laws that don't or aren't known ("X")."""
    maker = laws.select(F.col("name").alias("dst"), F.coalesce(making, F.lit(False)).alias("__maker"))
    of = {column: label for label, column in relations.items()}
    reach = edges(laws, list(of)).join(maker, "dst", "left").withColumn("__maker", F.coalesce("__maker", F.lit(False)))
    label = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("kind")]
    label = F.when(F.col("__maker"), F.concat(label, F.lit(" Maker"))).otherwise(label)
    per = reach.groupBy("src").agg(F.collect_set(label).alias("__reach"))
    own = F.array_compact(F.array(F.when(making, "Making"), F.when(commencing, "Commencing")))
    out = laws.select("name", own.alias("__own")).join(per.withColumnRenamed("src", "name"), "name", "left")
    return out.select("name", F.array_sort(F.concat("__own", F.coalesce("__reach", F.array().cast("array<string>")))).alias("labels"))


def cascade(edge_rows: DataFrame, seeds: DataFrame, layers: int | None = LAYERS) -> DataFrame:
    """``name, layer, sources``: laws reached from the seeds (``name``) in at
    most ``layers`` steps (None: until nothing new is reached), each in its first layer, with the laws of the layer
    before that lead to it; edges to itself don't count. Every layer is cut
    from its lineage, so the plan doesn't grow with the depth."""
    links = edge_rows.select("src", "dst").where(F.col("src") != F.col("dst")).distinct()
    seen = seeds.select("name").distinct()
    frontier, out = seen, []
    for layer in count(1) if layers is None else range(1, layers + 1):
        step = links.join(frontier.select(F.col("name").alias("src")), "src", "left_semi").join(seen.select(F.col("name").alias("dst")), "dst", "left_anti")
        found = stored(step.groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("sources")))
        if layers is None and out and found.isEmpty():
            break
        out.append(found.withColumn("layer", F.lit(layer)).select("name", "layer", "sources"))
        frontier = found.select("name")
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, out)


def is_revocation(affect: Column) -> Column:
    low = F.lower(F.coalesce(affect, F.lit("")))
    return low.contains("repeal") | low.contains("revoke")


def is_full_revocation(affect: Column) -> Column:
    low = F.lower(F.coalesce(affect, F.lit("")))
    return low.contains("in full") | (low.contains("repeal") & ~low.contains("in part"))


def change_line(target: Column, affect: Column, applied: Column) -> Column:
    """``target affect [applied]`` of what is there; null for nothing."""
    t, a, p = (F.coalesce(x, F.lit("")) for x in (target, affect, applied))
    tail = F.concat(a, F.lit(" ["), p, F.lit("]"))
    return F.when((t == "") & (a == ""), F.lit(None)).when(t == "", tail).when(a == "", t).otherwise(F.concat(t, F.lit(" "), tail))


def change_stats(changes: DataFrame) -> DataFrame:
    """Per law over its changes (``law_name, item, affect``): totals, changes and
    revocations by other laws, distinct laws of either kind, changes by itself,
    and the status that the revocations mean."""
    own = F.col("item") == F.col("law_name")
    gone = is_revocation(F.col("affect"))
    full = is_full_revocation(F.col("affect"))
    per = changes.groupBy("law_name").agg(
        F.count(F.lit(1)).alias("total_changes"),
        F.count_if(~own & ~gone).alias("amendments"),
        F.count_if(~own & gone).alias("revocations"),
        F.count_distinct(F.when(~own, F.col("item"))).alias("laws"),
        F.count_distinct(F.when(~own & ~gone, F.col("item"))).alias("amending_laws"),
        F.count_distinct(F.when(~own & gone, F.col("item"))).alias("revoking_laws"),
        F.count_if(own).alias("self_changes"),
        F.bool_or(~own & gone & full).alias("__full"),
    )
    status = F.when(F.col("revocations") == 0, IN_FORCE).when(F.col("__full"), REVOKED).otherwise(PART_REVOKED)
    return per.withColumn("status", status).drop("__full")


def stats_map(changes: DataFrame) -> DataFrame:
    """``law_name, stats``: a map from changing law to its title, number of
    changes and distinct details, as nested documents hold it."""
    detail = F.struct("target", "affect", "applied")
    something = F.coalesce(filled(F.col("target")), filled(F.col("affect"))).isNotNull()
    per = changes.groupBy("law_name", "item").agg(F.first("title", ignorenulls=True).alias("title"), F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set(F.when(something, detail))).alias("details"))
    return per.groupBy("law_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", F.struct(F.col("item").alias("name"), "title", "count", "details"))))).alias("stats"))


def ordered_links(changes: DataFrame) -> DataFrame:
    """``law_name, links``: distinct changing laws, the newest year and greatest
    number first."""
    parts = r"_(\d{4})_(\d+)$"
    one = changes.where(F.col("item").isNotNull()).select("law_name", "item", F.regexp_extract("item", parts, 1).alias("y"), F.regexp_extract("item", parts, 2).alias("n")).distinct()
    rank = F.struct((-F.coalesce(F.expr("try_cast(y as bigint)"), F.lit(0))).alias("y"), (-F.coalesce(F.expr("try_cast(n as bigint)"), F.lit(0))).alias("n"), F.col("item"))
    return one.groupBy("law_name").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["item"]).alias("links"))


def self_change_text(changes: DataFrame) -> DataFrame:
    """Per law the changes it makes to itself: a heading and distinct lines."""
    own = changes.where(F.col("item") == F.col("law_name"))
    per = own.groupBy("law_name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(change_line(F.col("target"), F.col("affect"), F.col("applied")))).alias("lines"))
    return per.select("law_name", F.concat_ws("\n", F.concat(F.col("n").cast("string"), F.lit(" self-amendments")), F.transform("lines", lambda x: F.concat(F.lit(" "), x))).alias("detail"))


def reconciled_status(register_status: Column, changes_status: Column) -> Column:
    """The more severe of two statuses and where it came from; equal ones agree."""
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    of = lambda c: F.coalesce(severity[c], F.lit(0))
    a, b = of(changes_status), of(register_status)
    return F.struct(F.when(a > b, changes_status).otherwise(register_status).alias("status"), F.when(a > b, "changes").when(b > a, "register").otherwise("both").alias("source"), (a != b).alias("conflict"))


def with_previous(rows: DataFrame, key: str, keep: Sequence[str], updated: str = "updated_at", synced: str = "synced_at") -> DataFrame:
    """Newest row of each key beside the version before it (``old_`` columns),
    null for a key with one version."""
    cols = list(dict.fromkeys([key, *keep, updated, synced]))
    one = rows.select(*cols).where(F.col(updated).isNotNull() & F.col(key).isNotNull())
    flat = [c for c, t in one.dtypes if "map<" not in t]
    first = Window.partitionBy(key, updated).orderBy(F.col(synced).asc_nulls_last(), F.xxhash64(*flat))
    versions = one.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    newest_first = Window.partitionBy(key).orderBy(F.col(updated).desc())
    two = versions.withColumn("__r", F.row_number().over(newest_first)).where("__r <= 2")
    new = two.where("__r = 1").drop("__r")
    old = two.where("__r = 2").select(key, *[F.col(c).alias(f"old_{c}") for c in keep])
    return new.join(old, key, "left")
