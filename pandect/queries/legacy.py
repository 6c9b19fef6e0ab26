"""Older texts written from the register's documents and read back, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pandect.operators import law_documents, legacy_texts, register
from pandect.operators.edges import change_line
from pandect.queries.problems import _DOCS
from pandect.queries.sql import NL
from pandect.sources.tables import table

WORDS = ["words", "heading", "table", "entry", "sum", "revoked", "repealed", "applied", "inserted", "substituted", "omitted"]


def _nodes(spark, d):
    return law_documents.law_nodes(table(spark, d, "uk_lrt"))


def _stat_texts(spark, d):
    """Details of a law as text: a block per affecting law, a line per change."""
    c = law_documents.detail_table(_nodes(spark, d)).where("target <> '' or affect <> ''")
    line = F.concat(F.lit(" "), change_line(F.col("target"), F.col("affect"), F.coalesce("applied", F.lit("?"))))
    blocks = c.groupBy("law_name", "item").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("detail_no", line.alias("t")))).alias("x"))
    block = F.concat(F.col("n").cast("string"), F.lit(" - Title of "), "item", F.lit("\nhttps://register.example/id/"), F.translate(F.substring("item", 4, 100), "_", "/"), F.lit("\n"), F.array_join(F.transform("x", lambda e: e["t"]), "\n"))
    return blocks.groupBy("law_name").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n\n").alias("text"))


def _stats(spark, d):
    read = _stat_texts(spark, d).select("law_name", F.explode(legacy_texts.stats_from_text(F.col("text"), WORDS)).alias("item", "s"))
    return read.select("law_name", "item", "s.title", "s.count", F.size("s.details").cast("bigint").alias("n_details"))


def _rules(spark, d):
    """Entries with holder and article as text and back."""
    e = law_documents.entry_table(_nodes(spark, d)).where("field = 'duty_holder' and item is not null and article is not null")
    text = F.concat(F.lit("["), "item", F.lit("]\nhttps://register.example/uksi/2000/1/"), "article", F.lit("\n"), F.upper("duty_type"), F.lit("\n\U0001f4cc "), F.coalesce("clause", F.lit("")))
    per = e.groupBy("law_name").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("text"))
    read = per.select("law_name", F.explode(legacy_texts.rules_from_text(F.col("text"), "OTHER")).alias("e"))
    return read.select("law_name", "e.*")


def _logs(spark, d):
    """Dates and families of laws as an old change log and back."""
    x = register.laws(table(spark, d, "uk_lrt"), "family", "md_date", "number").where("md_date is not null and family is not null")
    text = F.concat(F.date_format("md_date", "d/M/yyyy"), F.lit("\n\U0001f53a_stats_count\nnil -> "), F.coalesce("number", F.lit("nil")), F.lit("\nAmending\n"), "family", F.lit("\nstray"))
    read = x.select("name", F.explode(legacy_texts.log_from_text(text)).alias("e"))
    return read.select("name", "e.timestamp", "e.summary", F.col("e.changes")["amending_stats_count"]["new"].alias("n"), F.col("e.changes")["amending"]["new"].alias("family"))


def _split(spark, d):
    """Statistics whose effects are put into their targets, and split again."""
    x = register.laws(table(spark, d, "uk_lrt"), "affected_by_stats_per_law")
    joined = F.transform_values("affected_by_stats_per_law", lambda k, v: F.when(v.isNotNull(), F.struct(v["name"].alias("name"), v["title"].alias("title"), v["url"].alias("url"), v["count"].alias("count"), F.transform(v["details"], lambda e: F.when(e.isNotNull(), F.struct(F.when(e["target"].isNotNull() & e["affect"].isNotNull(), F.concat(e["target"], F.lit(" "), e["affect"])).otherwise(e["target"]).alias("target"), F.when(e["target"].isNull(), e["affect"]).alias("affect"), e["applied"].alias("applied")))).alias("details"))))
    out = x.select("name", F.explode(legacy_texts.split_affects(joined, WORDS)).alias("item", "s")).select("name", "item", F.posexplode("s.details").alias("n", "e"))
    return out.where("e is not null").select("name", "item", (F.col("n") + 1).alias("detail_no"), "e.target", "e.affect", "e.applied")


QUERIES = {
    "stats_from_text": _stats,
    "rules_from_text": _rules,
    "log_from_text": _logs,
    "split_affects": _split,
    "plus_separated": lambda spark, d: register.laws(table(spark, d, "uk_lrt"), "family").select("name", legacy_texts.plus_separated(F.concat("family", F.lit(", Scope + Extent"))).alias("value")),
}

ORACLE = {
    "stats_from_text": f"{_DOCS} SELECT law_name, item, 'Title of ' || item AS title, CAST(count(*) AS INT) AS count, count(*) AS n_details FROM detail WHERE x IS NOT NULL AND (x.target <> '' OR x.affect <> '') GROUP BY 1, 2",
    "rules_from_text": f"{_DOCS} SELECT law_name, item AS holder, article, upper(duty_type) AS duty_type, nullif(trim(clause), '') AS clause FROM entries WHERE field = 'duty_holder' AND item IS NOT NULL AND article IS NOT NULL AND duty_type IS NOT NULL",
    "log_from_text": f"WITH {NL} SELECT name, strftime(md_date, '%Y-%m-%dT00:00:00Z') AS \"timestamp\", 'Updated 2 fields: amending, amending_stats_count' AS summary, number AS n, family FROM nl WHERE md_date IS NOT NULL AND family IS NOT NULL",
    "split_affects": f"{_DOCS} SELECT law_name AS name, item, CAST(detail_no AS INT) AS detail_no, x.target AS target, x.affect AS affect, x.applied AS applied FROM detail WHERE x IS NOT NULL",
    "plus_separated": f"WITH {NL} SELECT name, regexp_replace(family, '\\s*[,+]\\s*', '+', 'g') || '+Scope+Extent' AS value FROM nl",
}
