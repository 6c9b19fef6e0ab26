"""Sessions and cascades made of the register, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pandect.operators import edges, register
from pandect.operators import worklists as W
from pandect.queries.sql import NL, NU, key_sql
from pandect.sources.tables import table

KINDS = ("reparse", "enacting_link")
STATUSES = ("pending", "processed")
#: Domains by the beginning of a family's name.
DOMAINS = {"AIR": "environment", "WATER": "environment", "PEAT": "environment", "WORKPLACE": "health_safety", "KILNS": "health_safety", "TRADE": "trade"}
ALLOWED = {"pending": ("parsed", "skipped"), "parsed": ("confirmed", "pending")}


def _laws(spark, d, *columns):
    return register.laws(table(spark, d, "uk_lrt"), *columns)


def records(spark, d):
    """One record per law: session by family, group by type, status by length of its name."""
    n = F.length("name")
    x = _laws(spark, d, "family", "type_code", "year", "md_date")
    return x.select(F.coalesce("family", F.lit("none")).alias("session_id"), F.col("name").alias("law_name"), F.col("type_code").alias("group"), F.when(n % 3 == 0, "confirmed").when(n % 3 == 1, "pending").otherwise("parsed").alias("status"), (F.col("year") % 2 == 0).alias("selected"), F.col("md_date").alias("at"))


def entries(spark, d):
    """Cascade entries: laws that a family's laws amend, or are amended by."""
    x = _laws(spark, d, "family", "amending", "amended_by")
    e = edges.edges(x, ["amending", "amended_by"]).join(x.select(F.col("name").alias("src"), F.coalesce("family", F.lit("none")).alias("session_id")), "src")
    kind = F.when(F.col("kind") == "amending", KINDS[0]).otherwise(KINDS[1])
    e = e.groupBy("session_id", F.col("dst").alias("affected_law"), kind.alias("update_type")).agg(F.array_sort(F.collect_set("src")).alias("source_laws"))
    n = F.length("affected_law")
    return e.withColumn("layer", (n % 3 + 1).cast("int")).withColumn("status", F.when(n % 2 == 0, STATUSES[0]).otherwise(STATUSES[1]))


def _sessions(spark, d):
    return records(spark, d).select("session_id").distinct()


def _updates(spark, d):
    """Every law's next status, and laws that have no record yet."""
    r = records(spark, d).select("law_name", F.when(F.length("law_name") % 2 == 0, "confirmed").otherwise("parsed").alias("status"), F.lit(1).alias("n"))
    new = entries(spark, d).select(F.col("affected_law").alias("law_name"), F.lit("pending").alias("status"), F.lit(0).alias("n")).distinct()
    return r.unionByName(new)


def _moved(spark, d, which):
    return W.transitions(records(spark, d).select("law_name", "status"), _updates(spark, d), ["law_name"], ALLOWED, "n")[which]


def _compared(spark, d):
    e = table(spark, d, "events")
    half = lambda first: register.percentile_rank(e.where((F.dayofmonth("ts") <= 15) if first else (F.dayofmonth("ts") > 15)), ["event_type"], "value", [50])
    return W.compared(half(True), half(False), "event_type", "p50").select("event_type", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "change_pct")


def _lists(spark, d):
    x = _laws(spark, d, "family", "amending", "linked_amending")
    return W.entries_of_lists(x.select(F.coalesce("family", F.lit("none")).alias("session_id"), "amending", "linked_amending"), {"amending": "reparse", "linked_amending": "enacting_link"})


def _reparsed(spark, d):
    x = _laws(spark, d, "number", "year")
    return W.results_per_item(x.select("name", "number"), F.expr("try_cast(number as int)"), "no number").select("name", "result", "error")


def _insert(spark, d):
    u = register.units(table(spark, d, "lat"), "section_type", "sort_key", "position", "depth", "text", "language", "amendment_count", "modification_count", "commencement_count", "extent_count", "editorial_count")
    rows = W.for_insert(u, F.concat(F.lit("law:"), "law_name"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    return rows.where("law_name is not null").groupBy("law_name").agg(F.count(F.lit(1)).alias("units"), F.sum("amendment_count").alias("amendments"), F.max("law_id").alias("law_id"), F.count_if(F.col("language") == "en").alias("english"))


def _listing(spark, d):
    x = _laws(spark, d, "title_en", "type_code", "year")
    listing = x.select("name", F.when(F.col("year") % 2 == 0, F.lit(" ")).otherwise(F.lit("listed")).alias("title_en"))
    return W.enriched(listing, x, "name", "title_en", ["type_code"])


def _aliases(spark, d):
    x = _laws(spark, d, "title_en", "number", "type_code", "family")
    return W.renamed(x, {"name": ["Name", "name"], "title": ["Title", "title", "title_en"], "kind": ["type_code", "family"]})


def _strategies(spark, d):
    x = _laws(spark, d, "title_en", "family")
    return W.strategies(x, {"title": F.col("title_en").contains("Order"), "family": F.col("family").isNotNull()})


def _marked(spark, d):
    return W.layer_counts(W.mark(entries(spark, d), F.col("layer") == 1, "processed").where("status = 'processed'"))


def _with_source(spark, d):
    x = _laws(spark, d, "family")
    return W.with_source(x.where("family is not null").select("name"), x.select("name").unionByName(x.select("name")).distinct(), ["name"])


QUERIES = {
    "session_records_pending": lambda s, d: W.with_status(records(s, d), "pending").select("session_id", "law_name"),
    "session_records_active": lambda s, d: W.with_status(records(s, d), "pending", "parsed").select("session_id", "law_name", "status"),
    "session_records_recent": lambda s, d: W.recent(records(s, d), "at", 10, "law_name").select("law_name", F.col("at").cast("string").alias("at")),
    "session_records_selected": lambda s, d: W.selected_in_group(records(s, d), "uksi").select("session_id", "law_name"),
    "session_counts": lambda s, d: W.counts_by_status(records(s, d), ["pending", "parsed", "confirmed"]),
    "session_stats": lambda s, d: W.session_stats(_sessions(s, d), entries(s, d), KINDS),
    "cascade_entries": lambda s, d: W.layered(entries(s, d)).select("session_id", "affected_law", "update_type", "layer", "place", F.array_join("source_laws", "|").alias("source_laws")),
    "cascade_pending": lambda s, d: W.sessions_with_pending(entries(s, d)),
    "cascade_summary": lambda s, d: W.cascade_summary(entries(s, d), STATUSES),
    "cascade_layer_counts": lambda s, d: W.layer_counts(entries(s, d)),
    "cascade_marked": _marked,
    "cascade_from_lists": _lists,
    "status_transitions": lambda s, d: _moved(s, d, 0),
    "status_refused": lambda s, d: _moved(s, d, 1),
    "records_with_source": _with_source,
    "reparse_results": _reparsed,
    "listing_by_day": lambda s, d: W.days("2010-01-01", "2015-12-31", _laws(s, d, "md_date"), "md_date").groupBy("md_date").agg(F.count(F.lit(1)).alias("laws")).select(F.col("md_date").cast("string").alias("day"), "laws"),
    "listing_enriched": _listing,
    "field_aliases": _aliases,
    "insert_projection": _insert,
    "metric_comparison": _compared,
    "match_strategies": _strategies,
    "split_by_flag": lambda s, d: W.split_on(_laws(s, d, "live"), F.col("live").contains("Revoked"))[1].select("name", "live"),
    "text_and_arrays": lambda s, d: _laws(s, d, "geo_extent", "amending").select("name", F.size(W.array_of(F.replace("geo_extent", F.lit("+"), F.lit(",")))).alias("parts"), W.text_of(F.col("amending")).alias("amending")).select("name", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("amending", F.lit("")).alias("amending")),
    "family_domains": lambda s, d: _laws(s, d, "family").select("name", W.domain_of(F.col("family"), DOMAINS).alias("domain")),
    "tenant_shape": lambda s, d: W.scoped(_laws(s, d, "type_code", "year"), "uksi", "type_code", F.col("year") > 2000).select("name", "year"),
    "key_answers": lambda s, d: W.answer({"laws": _laws(s, d, "year").select("name", "year")}, "laws/*", {"laws": "name"}),
}

_R = f"WITH {NL}, r AS (SELECT coalesce(family, 'none') AS session_id, name AS law_name, type_code AS \"group\", CASE length(name) % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'pending' ELSE 'parsed' END AS status, year % 2 = 0 AS selected, md_date AS made FROM nl)"
_E = f"""{_R}, eg AS (SELECT DISTINCT session_id, src, dst, kind FROM (
  SELECT coalesce(family, 'none') AS session_id, name AS src, {key_sql("x")} AS dst, 'reparse' AS kind FROM (SELECT name, family, unnest(amending) AS x FROM nl)
  UNION ALL SELECT coalesce(family, 'none'), name, {key_sql("x")}, 'enacting_link' FROM (SELECT name, family, unnest(amended_by) AS x FROM nl)) WHERE dst IS NOT NULL),
en AS (SELECT session_id, dst AS affected_law, kind AS update_type, list_sort(list(DISTINCT src)) AS source_laws, CAST(length(dst) % 3 + 1 AS INT) AS layer, CASE WHEN length(dst) % 2 = 0 THEN 'pending' ELSE 'processed' END AS status FROM eg GROUP BY ALL)"""
_MOVE = f"""{_E}, up AS (SELECT law_name, CASE WHEN length(law_name) % 2 = 0 THEN 'confirmed' ELSE 'parsed' END AS t FROM r UNION ALL SELECT DISTINCT affected_law, 'pending' FROM en WHERE affected_law NOT IN (SELECT law_name FROM r)),
bo AS (SELECT law_name, r.status AS status, t, coalesce(r.status IS NULL OR (r.status = 'pending' AND t IN ('parsed', 'skipped')) OR (r.status = 'parsed' AND t IN ('confirmed', 'pending')), false) AS ok FROM up LEFT JOIN r USING (law_name))"""
_HALF = "SELECT event_type, max(CASE WHEN rn = floor(0.5 * (n - 1)) + 1 THEN value END) AS p FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND day(ts) {op} 15) GROUP BY 1"

ORACLE = {
    "session_records_pending": f"{_R} SELECT session_id, law_name FROM r WHERE status = 'pending'",
    "session_records_active": f"{_R} SELECT session_id, law_name, status FROM r WHERE status IN ('pending', 'parsed')",
    "session_records_recent": f"{_R} SELECT law_name, CAST(made AS VARCHAR) AS \"at\" FROM r ORDER BY made DESC NULLS LAST, law_name LIMIT 10",
    "session_records_selected": f"{_R} SELECT session_id, law_name FROM r WHERE \"group\" = 'uksi' AND selected",
    "session_counts": f"{_R} SELECT \"group\", count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'parsed') AS parsed, count(*) FILTER (WHERE status = 'confirmed') AS confirmed FROM r GROUP BY 1",
    "session_stats": f"{_E} SELECT s.session_id, count(affected_law) AS entries, count(*) FILTER (WHERE update_type = 'reparse') AS reparse, count(*) FILTER (WHERE update_type = 'enacting_link') AS enacting_link, count(*) FILTER (WHERE status = 'pending') AS pending FROM (SELECT DISTINCT session_id FROM r) s LEFT JOIN en USING (session_id) GROUP BY 1",
    "cascade_entries": f"{_E} SELECT session_id, affected_law, update_type, layer, row_number() OVER (PARTITION BY session_id ORDER BY layer, update_type, affected_law) AS place, array_to_string(source_laws, '|') AS source_laws FROM en",
    "cascade_pending": f"{_E} SELECT session_id, count(*) AS pending FROM en WHERE status = 'pending' GROUP BY 1",
    "cascade_summary": f"{_E}, l AS (SELECT session_id, count(DISTINCT x) AS source_laws FROM (SELECT session_id, unnest(source_laws) AS x FROM en) GROUP BY 1) SELECT session_id, min(layer) AS first_layer, count(DISTINCT layer) AS layers, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processed') AS processed, any_value(l.source_laws) AS source_laws FROM en JOIN l USING (session_id) GROUP BY 1",
    "cascade_layer_counts": f"{_E} SELECT session_id, layer, count(*) AS entries FROM en GROUP BY 1, 2",
    "cascade_marked": f"{_E} SELECT session_id, layer, count(*) AS entries FROM en WHERE status = 'processed' OR layer = 1 GROUP BY 1, 2",
    "cascade_from_lists": f"WITH {NL} SELECT DISTINCT coalesce(family, 'none') AS session_id, kind AS update_type, x AS affected_law FROM (SELECT family, 'reparse' AS kind, unnest(amending) AS x FROM nl UNION ALL SELECT family, 'enacting_link', unnest(linked_amending) FROM nl) WHERE x <> ''",
    "status_transitions": f"{_MOVE} SELECT law_name, CASE WHEN ok THEN t ELSE status END AS status FROM bo",
    "status_refused": f"{_MOVE} SELECT law_name, status, t AS refused FROM bo WHERE NOT ok",
    "records_with_source": f"WITH {NL} SELECT name, CASE WHEN family IS NOT NULL THEN 'table' ELSE 'file' END AS source FROM nl",
    "reparse_results": f"WITH {NL} SELECT name, TRY_CAST(number AS INT) AS result, CASE WHEN TRY_CAST(number AS INT) IS NULL THEN 'no number' END AS error FROM nl",
    "listing_by_day": f"WITH {NL} SELECT CAST(md_date AS VARCHAR) AS day, count(*) AS laws FROM nl WHERE md_date BETWEEN DATE '2010-01-01' AND DATE '2015-12-31' GROUP BY 1",
    "listing_enriched": f"WITH {NL} SELECT name, CASE WHEN year % 2 = 0 THEN title_en ELSE 'listed' END AS title_en, type_code FROM nl",
    "field_aliases": f"WITH {NL} SELECT name, title_en AS title, coalesce(type_code, family) AS kind FROM nl",
    "insert_projection": f"WITH {NU} SELECT law_name, count(*) AS units, CAST(sum(coalesce(amendment_count, 0)) AS BIGINT) AS amendments, 'law:' || law_name AS law_id, count(*) FILTER (WHERE coalesce(language, 'en') = 'en') AS english FROM nu WHERE law_name IS NOT NULL GROUP BY law_name",
    "metric_comparison": f"WITH a AS ({_HALF.format(op='<=')}), b AS ({_HALF.format(op='>')}) SELECT event_type, round(a.p, 6) AS before, round(b.p, 6) AS after, round((b.p - a.p) * 100.0 / a.p, 1) AS change_pct FROM a FULL JOIN b USING (event_type)",
    "match_strategies": f"WITH {NL} SELECT CASE WHEN contains(title_en, 'Order') THEN 'title' WHEN family IS NOT NULL THEN 'family' ELSE 'none' END AS strategy, count(*) AS rows FROM nl GROUP BY 1",
    "split_by_flag": f"WITH {NL} SELECT name, live FROM nl WHERE NOT coalesce(contains(live, 'Revoked'), false)",
    "text_and_arrays": f"WITH {NL} SELECT name, CAST(coalesce(len(string_split(nullif(replace(geo_extent, '+', ','), ''), ',')), 0) AS INT) AS parts, coalesce(array_to_string(amending, ','), '') AS amending FROM nl",
    "family_domains": f"WITH {NL} SELECT name, CASE " + " ".join(f"WHEN starts_with(family, '{a}') THEN '{b}'" for a, b in DOMAINS.items()) + " END AS domain FROM nl",
    "tenant_shape": f"WITH {NL} SELECT name, year FROM nl WHERE type_code = 'uksi' AND year > 2000",
    "key_answers": f"WITH {NL} SELECT name AS key, '{{\"name\":\"' || name || '\",\"year\":' || coalesce(CAST(year AS VARCHAR), 'null') || '}}' AS value FROM nl",
}
