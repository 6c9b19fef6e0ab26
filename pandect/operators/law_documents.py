"""Problem 4 on the register: holders, categories, affecting laws and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandect.functions.text import strip_blanks
from pandect.operators.shredding import adjacency, entities
from pandect.plans.cut import stored
from pandect.plans.newest import newest

KEYS = ["law_name", "field"]
STATS = "affected_by_stats_per_law"
#: Names of the parts that a document in document form may have; an object without any is a map of marked names.
PARTS = ("entries", "holders", "categories", "values", "articles")
LISTS = ("holders", "categories", "values")
NAME = {"duty_holder": "holder", "popimar": "category"}


def law_nodes(laws: DataFrame) -> DataFrame:
    """Adjacency table of the three nested columns, from the newest row of each law."""
    rows = newest(laws, "name", ["duty_holder", "popimar", STATS])
    as_json = F.to_json(STATS, {"ignoreNullFields": "false"})
    docs = [F.struct(F.lit(f).alias("field"), c.alias("document")) for f, c in (("duty_holder", F.col("duty_holder")), ("popimar", F.col("popimar")), (STATS, as_json))]
    # The table is stored: entity tables read different columns and paths of it, and documents are parsed once.
    return stored(adjacency(rows.select(F.col("name").alias("law_name"), F.inline(F.array(*docs))), KEYS, "document"))


def entry_table(nodes: DataFrame) -> DataFrame:
    """One row per object in a document's ``entries``: the name it gives
    (``item``, null without one), its 1-based place and its optional fields."""
    e = entities(nodes.where(F.col("field") != STATS), KEYS, F.col("path") == "$.entries[]", ["holder", "category", "duty_type", "clause", "article", "regex_clause_confidence"])
    name = strip_blanks(F.when(F.col("field") == "duty_holder", F.col("field_holder")).otherwise(F.col("field_category")))
    return e.select(*KEYS, "node", "parent", F.col("ordinal").alias("entry_no"), F.nullif(name, F.lit("")).alias("item"), F.col("field_duty_type").alias("duty_type"), F.col("field_clause").alias("clause"), F.col("field_article").alias("article"), F.expr("try_cast(field_regex_clause_confidence as double)").alias("confidence"))


def item_table(nodes: DataFrame) -> DataFrame:
    """Holders and categories that a document names, each once per document:
    elements of its lists, keys of a map that aren't marked false, and the
    names in its entries."""
    docs = nodes.where(F.col("field") != STATS)
    # Nodes directly below the root, and the elements of its lists.
    listed = docs.where((F.col("kind") == "string") & F.col("path").isin("$[]", *[f"$.{x}[]" for x in LISTS])).select(*KEYS, F.col("scalar").alias("item"))
    # A key directly below the root has ordinal and label; node 0 is the root. Documents in document form have no marks.
    marked = docs.where((F.col("parent") == 0) & (F.col("kind") == "boolean") & (F.col("scalar") == "true") & F.col("label").isNotNull() & ~F.col("label").isin(*PARTS)).select(*KEYS, F.col("label").alias("item"))
    named = entry_table(nodes).select(*KEYS, "item")
    items = listed.unionByName(marked).unionByName(named).select(*KEYS, strip_blanks(F.col("item")).alias("item"))
    return items.where("item <> ''").distinct()


def affecting_table(nodes: DataFrame) -> DataFrame:
    """One row per affecting law: its key, place and scalar fields; a law whose
    record is null has a row as well."""
    stats = nodes.where(F.col("field") == STATS)
    laws = stats.where((F.col("parent") == 0) & F.col("label").isNotNull()).select(*KEYS, "node", F.col("label").alias("item"), "ordinal")
    fields = entities(stats, KEYS, F.col("parent") == 0, ["name", "title", "url", "count"])
    joined = laws.join(fields.select(*KEYS, "node", F.col("field_name").alias("affecting_name"), "field_title", "field_url", "field_count"), [*KEYS, "node"], "left")
    return joined.select(*KEYS, "node", "item", "affecting_name", F.col("field_title").alias("title"), F.col("field_url").alias("url"), F.col("field_count").cast("int").alias("n_changes"))


def detail_table(nodes: DataFrame) -> DataFrame:
    """One row per detail of an affecting law that is not null, with the law's
    key and the 1-based place of the detail in its list."""
    stats = nodes.where(F.col("field") == STATS)
    details = entities(stats, KEYS, F.col("ordinal").isNotNull() & F.col("label").isNull(), ["target", "affect", "applied"])
    lists = stats.where((F.col("kind") == "array") & (F.col("label") == "details")).select(*KEYS, F.col("node").alias("parent"), F.col("parent").alias("law_node"))
    laws = stats.where((F.col("parent") == 0) & F.col("label").isNotNull()).select(*KEYS, F.col("node").alias("law_node"), F.col("label").alias("item"))
    joined = details.drop("label").join(lists, [*KEYS, "parent"]).join(laws, [*KEYS, "law_node"])
    return joined.select(*KEYS, "item", F.col("ordinal").alias("detail_no"), F.col("field_target").alias("target"), F.col("field_affect").alias("affect"), F.col("field_applied").alias("applied"))


def found(laws: DataFrame) -> DataFrame:
    """``law_name, field, item_key, child_no``: one row per row of the flat tables."""
    nodes = law_nodes(laws)
    zero = F.lit(0).alias("child_no")
    parts = [
        item_table(nodes).select(*KEYS, F.col("item").alias("item_key"), zero),
        entry_table(nodes).where("item is not null").select(*KEYS, F.col("item").alias("item_key"), F.col("entry_no").alias("child_no")),
        affecting_table(nodes).select(*KEYS, F.col("item").alias("item_key"), zero),
        detail_table(nodes).select(*KEYS, F.col("item").alias("item_key"), F.col("detail_no").alias("child_no")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
