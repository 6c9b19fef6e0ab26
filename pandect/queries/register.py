"""Reads, facets, queues, summaries and views, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pandect.operators import filters, law_documents, register, views
from pandect.queries.problems import _DOCS
from pandect.queries.sql import NA, NL, NU, key_sql
from pandect.sources.tables import table

#: Dates that the reference takes from the clock.
AS_OF = "2019-08-20"
SINCE = "2023-06-01 00:00:00"
WANTED = ["UK_ukpga_1987_5001", "UK_uksi_2004_5002", "UK_xx_1900_1", "UK_asp_2009_5005"]
LAW_COLUMNS = ["id", "name", "title_en", "type_code", "year", "number", "family", "geo_extent", "live", "md_date", "function", "updated_at"]
SHAPE = ["id", "name", "title_en", "type_code", "year", "number", "family", "live", "geo_extent", "md_date"]


def _laws(fn, *columns):
    return lambda spark, d: fn(register.laws(table(spark, d, "uk_lrt"), *(columns or LAW_COLUMNS)))


def _units(fn, *columns):
    return lambda spark, d: fn(register.units(table(spark, d, "lat"), *columns))


def _notes(fn, *columns):
    return lambda spark, d: fn(register.annotations(table(spark, d, "amendment_annotations"), *columns))


def _all(fn):
    def run(spark, d):
        laws = register.laws(table(spark, d, "uk_lrt"), *LAW_COLUMNS)
        # Only what the queries use: the tie-break of the newest row reads every column that is kept.
        units = register.units(table(spark, d, "lat"), "law_id")
        return fn(laws, units, register.annotations(table(spark, d, "amendment_annotations"), "law_id", "code"))

    return run


_FILTERS = [
    {"field": "title_en", "operator": "contains", "value": "kiln"},
    {"field": "title_en", "operator": "not_contains", "value": "act"},
    {"field": "year", "operator": "greater_or_equal", "value": 1990},
    {"field": "year", "operator": "less_or_equal", "value": 2020},
    {"field": "type_code", "operator": "in", "value": ["uksi", "ssi", "wsi"]},
    {"field": "family", "operator": "is_not_empty"},
    {"field": "md_date", "operator": "is_after", "value": "1991-01-01"},
    {"field": "md_date", "operator": "is_before", "value": "2020-01-01"},
    {"field": "name", "operator": "starts_with", "value": "uk_"},
    {"field": "live", "operator": "not_equals", "value": "?"},
    {"field": "name", "operator": "sounds_like", "value": "x"},
]
_EDGE_FILTERS = [
    {"field": "geo_extent", "operator": "is_empty"},
    {"field": "year", "operator": "greater_than", "value": 1980},
    {"field": "year", "operator": "less_than", "value": 2015},
    {"field": "number", "operator": "ends_with", "value": "1"},
    {"field": "type_code", "operator": "equals", "value": "uksi"},
]


def _json_row(df):
    fields = ["name", "title_en", "year", "type_code", "family", "live"]
    return df.select("name", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


QUERIES = {
    "laws_by_id": _laws(lambda x: x.where(F.col("name") == WANTED[1]).select("id", "name", "title_en"), "id", "title_en"),
    "laws_by_family": _laws(lambda x: x.where("family = 'RECORDS'").select("name", "family"), "family"),
    "laws_by_optional_families": _laws(lambda x: x.where(filters.all_of([filters.equal_if("family", "PEAT & MOOR"), filters.equal_if("geo_extent", None)])).select("name", "family"), "family", "geo_extent"),
    "search_optional": _laws(lambda x: register.optional_search(x, family=None, type_code="uksi", text="landing").select("name", "title_en", "number", "year"), "family", "year", "type_code", "live", "title_en", "number"),
    "screening": _laws(lambda x: register.screening(x).select("name", "year", "md_date"), "function", "live", "family", "geo_extent", "year", "md_date"),
    "screening_page": _laws(lambda x: filters.page(register.screening(x, family="RECORDS"), [F.desc_nulls_first("year"), F.desc_nulls_first("md_date"), F.asc("name")], 100).select("name", "year", "md_date"), "function", "live", "family", "geo_extent", "year", "md_date"),
    "laws_in_force": _laws(lambda x: x.where(F.col("live") == register.IN_FORCE).select("name", "live"), "live"),
    "laws_recent": _laws(lambda x: register.amended_within(x, "md_date", AS_OF).select("name", "md_date"), "md_date"),
    "marked_laws": _laws(lambda x: register.marked(x, "RECORDS", "Making").select("name", "family"), "family", "function", "type_code"),
    "batch_exists": _laws(lambda x: register.present(x, WANTED).select("id", "name"), "id"),
    "batch_missing": lambda spark, d: register.missing(spark.createDataFrame([(n,) for n in WANTED], "name string"), register.laws(table(spark, d, "uk_lrt"), "id"), "name"),
    "display_names": _laws(lambda x: x.select("id", register.display_name().alias("display_name"), register.title_with_year().alias("title_with_year")), "id", "title_en", "year"),
    "law_json": _laws(_json_row, "title_en", "year", "type_code", "family", "live"),
    "view_filters": _laws(lambda x: x.where(filters.where_all(_FILTERS, filters.recent_years("year", 2024))).select("name", "title_en", "year")),
    "view_filters_edges": _laws(lambda x: x.where(filters.where_all(_EDGE_FILTERS, filters.recent_years("year", 2024))).select("name", "number"), "geo_extent", "year", "number", "type_code"),
    "default_shape": _laws(lambda x: x.where(filters.where_all([], filters.recent_years("year", 2024))).select("name", "year"), "year"),
    "public_shape": _laws(lambda x: filters.shape(x, "year >= 2015 and type_code = 'asp'", ["id", "name", "function", "year", "secret"], SHAPE)),
    "units_of_law": _units(lambda u: u.where(F.col("law_name") == "UK_ukpga_1987_5001").select("section_id", "sort_key", "position", "depth"), "law_name", "sort_key", "position", "depth"),
    "units_by_type": _units(lambda u: u.where("section_type = 'heading'").select("section_id", "law_name", "text"), "law_name", "section_type", "text"),
    "units_in_order": _units(lambda u: filters.page(u.where(F.col("law_name") == "UK_uksi_2004_5002"), [F.asc_nulls_last("sort_key"), F.asc_nulls_last("position"), F.asc("section_id")], 50, 25).select("section_id", "sort_key", "position"), "law_name", "sort_key", "position"),
    "units_keyset": _units(lambda u: filters.after(u, ["law_name", "section_id"], ["UK_uksi", ""], 40).select("law_name", "section_id"), "law_name"),
    "annotations_by_type": _notes(lambda a: a.where("code_type = 'amendment'").select("id", "law_name", "code"), "law_name", "code", "code_type"),
    "facet_families": _laws(lambda x: register.facet(x, "family"), "family"),
    "facet_years": _laws(lambda x: register.facet(x, "year", descending=True), "year"),
    "facet_types": _laws(lambda x: register.facet(x, "type_code"), "type_code"),
    "facet_statuses": _laws(lambda x: register.facet(x, "live"), "live"),
    "section_counts": _units(lambda u: register.counts_by(u, "section_type"), "law_name", "section_type"),
    "code_counts": _notes(lambda a: register.counts_by(a, "code_type"), "law_name", "code_type"),
    "stats_row": lambda spark, d: register.table_stats(table(spark, d, "lat"), table(spark, d, "amendment_annotations")),
    "law_marks": _laws(lambda x: x.select("name", F.array_join(F.array_sort(F.map_keys("function")), "|").alias("marks"), F.array_join(F.array_sort(F.map_keys(F.map_filter("function", lambda k, v: v))), "|").alias("true_marks")), "function"),
    "work_queue": _all(lambda x, u, a: register.work_queue(x, u).drop("marks")),
    "work_queue_missing": _all(lambda x, u, a: register.work_queue(x, u, "missing").select("law_name", "queue_reason")),
    "work_queue_stale": _all(lambda x, u, a: register.work_queue(x, u, "stale").select("law_name", "law_updated_at", "latest_unit_updated_at")),
    "work_queue_counts": _all(lambda x, u, a: register.queue_counts(register.work_queue(x, u))),
    "client_queue": _all(lambda x, u, a: register.queue_from_counts(x.join(register.unit_stats(u), F.col("id") == F.col("law_id"), "left")).select("name", "queue_reason")),
    "law_summary": _all(lambda x, u, a: register.law_summary(x, u, a)),
    "law_summary_search": _all(lambda x, u, a: register.law_summary(x, u, a, text="tramway", type_code="uksi")),
    "incremental_units": _all(lambda x, u, a: register.changed_since(u, x, SINCE).select("section_id", "law_name", "law_title", "law_type_code", "law_year", "updated_at")),
    "incremental_annotations": _all(lambda x, u, a: register.changed_since(a, x, SINCE).select("id", "law_name", "law_title", "code", "updated_at")),
    "incremental_by_law": _all(lambda x, u, a: register.changed_since(u, x, "2022-01-01 00:00:00", ["UK_ukpga_2013_5007", "UK_asp_2009_5005"]).select("section_id", "law_name", "law_year")),
    "incremental_page": _all(lambda x, u, a: filters.page(register.changed_since(u, x, SINCE), [F.asc("updated_at"), F.asc("section_id")], 500).select("section_id", "updated_at")),
    "entries_queue": lambda spark, d: register.entries_queue(law_documents.entry_table(law_documents.law_nodes(table(spark, d, "uk_lrt"))), 0.5),
    "json_values": lambda spark, d: table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
    "percentile_report": lambda spark, d: register.percentile_rank(table(spark, d, "events"), ["event_type"], "value", [50, 95, 99]),
    "text_lengths": _units(lambda u: register.percentile_rank(u.select("section_type", F.length("text").cast("bigint").alias("characters")), ["section_type"], "characters", [50, 95, 99]), "law_name", "section_type", "text"),
    **{f"view_{v}": _laws(lambda x, v=v: views.build(x, v, AS_OF)) for v in views.VIEWS if v.startswith(("new_", "by_"))},
    **{f"group_{v}": _laws(lambda x, v=v: views.grouped(x, v, AS_OF)) for v in ("new_last_3_years", "by_family", "by_status", "by_type", "by_extent")},
}

_QUEUE = f"""
WITH {NL}, {NU}, agg AS (SELECT law_id, count(*) AS unit_count, max(updated_at) AS latest_unit FROM nu WHERE law_id IS NOT NULL GROUP BY 1),
q AS (SELECT id AS law_id, name AS law_name, title_en, year, type_code, family, live, nl.updated_at AS law_updated_at, coalesce(unit_count, 0) AS unit_count, latest_unit AS latest_unit_updated_at,
    CASE WHEN coalesce(unit_count, 0) = 0 THEN 'missing' WHEN nl.updated_at > latest_unit + INTERVAL 6 MONTH THEN 'stale' END AS queue_reason
  FROM nl LEFT JOIN agg ON agg.law_id = nl.id WHERE function['Making'] = true AND title_en IS NOT NULL AND family IS NOT NULL AND family NOT IN ('_todo', '🖤 X: No Family'))
"""
_SUMMARY = f"""
WITH {NL}, {NU}, {NA}, s AS (SELECT u.law_name, u.law_id, nl.title_en, nl.year, nl.type_code, count(u.section_id) AS unit_count,
    coalesce((SELECT count(*) FROM na WHERE na.law_name = u.law_name), 0) AS annotation_count FROM nu u JOIN nl ON nl.id = u.law_id GROUP BY ALL)
"""
_PCT = "list_extract(list_sort(list(v)), CAST(floor({p} / 100.0 * (count(*) - 1)) AS INT) + 1) AS p{p}"
_PERCENTILES = "SELECT {k}, " + ", ".join(_PCT.format(p=p) for p in (50, 95, 99)) + ", min(v) AS least, max(v) AS greatest, count(*) AS n FROM ({src}) WHERE v IS NOT NULL GROUP BY {k}"


def _view_sql(name: str, select: str = "*") -> str:
    v, at = views.VIEWS[name], views.calendar(AS_OF)
    columns = ["name", "title_en", "type_code", "live", "family"]
    cond = ["true"]
    if v.date:
        columns += [v.date, f"CAST(year({v.date}) AS INT) AS {v.date}_year", f"CAST(month({v.date}) AS INT) AS {v.date}_month"]
        cond.append(f"{v.date} > DATE '{at[v.start]}'")
        if v.end:
            cond.append(f"{v.date} < DATE '{at[v.end]}'")
    columns += [g for g in v.group if g not in columns and not v.date]
    inner = f"SELECT {', '.join(columns)} FROM nl WHERE {' AND '.join(cond)}"
    if select != "*":
        return f"WITH {NL} SELECT {', '.join(v.group)}, count(*) AS n FROM ({inner}) GROUP BY ALL"
    return f"WITH {NL} {inner}"


_NAMES = ", ".join(f"'{n}'" for n in WANTED)
ORACLE = {
    "law_json": f"WITH {NL} SELECT name, CAST(json_object('name', name, 'title_en', title_en, 'year', year, 'type_code', type_code, 'family', family, 'live', live) AS VARCHAR) AS record FROM nl",
    "laws_by_id": f"WITH {NL} SELECT id, name, title_en FROM nl WHERE name = '{WANTED[1]}'",
    "laws_by_family": f"WITH {NL} SELECT name, family FROM nl WHERE family = 'RECORDS'",
    "laws_by_optional_families": f"WITH {NL} SELECT name, family FROM nl WHERE family = 'PEAT & MOOR'",
    "search_optional": f"WITH {NL} SELECT name, title_en, number, year FROM nl WHERE type_code = 'uksi' AND (title_en ILIKE '%landing%' OR number ILIKE '%landing%' OR name ILIKE '%landing%')",
    "screening": f"WITH {NL} SELECT name, year, md_date FROM nl WHERE list_contains(map_keys(function), 'Making') AND live = '✔ In force'",
    "screening_page": f"WITH {NL} SELECT name, year, md_date FROM nl WHERE list_contains(map_keys(function), 'Making') AND live = '✔ In force' AND family = 'RECORDS' ORDER BY year DESC NULLS FIRST, md_date DESC NULLS FIRST, name LIMIT 100",
    "laws_in_force": f"WITH {NL} SELECT name, live FROM nl WHERE live = '✔ In force'",
    "laws_recent": f"WITH {NL} SELECT name, md_date FROM nl WHERE md_date > DATE '{AS_OF}' - INTERVAL 1 YEAR",
    "marked_laws": f"WITH {NL} SELECT name, family FROM nl WHERE family = 'RECORDS' AND function['Making'] = true",
    "batch_exists": f"WITH {NL} SELECT id, name FROM nl WHERE name IN ({_NAMES})",
    "batch_missing": f"SELECT name FROM (SELECT unnest([{_NAMES}]) AS name) WHERE name NOT IN (SELECT name FROM uk_lrt WHERE updated_at IS NOT NULL AND name IS NOT NULL)",
    "display_names": f"WITH {NL} SELECT id, coalesce(name, title_en, 'Record #' || id) AS display_name, concat(title_en, ' (', year, ')') AS title_with_year FROM nl",
    "view_filters": f"WITH {NL} SELECT name, title_en, year FROM nl WHERE title_en ILIKE '%kiln%' AND title_en NOT ILIKE '%act%' AND year >= 1990 AND year <= 2020 AND type_code IN ('uksi', 'ssi', 'wsi') AND family <> '' AND md_date > DATE '1991-01-01' AND md_date < DATE '2020-01-01' AND name ILIKE 'uk_%' AND live <> '?'",
    "view_filters_edges": f"WITH {NL} SELECT name, number FROM nl WHERE coalesce(geo_extent, '') = '' AND year > 1980 AND year < 2015 AND number LIKE '%1' AND type_code = 'uksi'",
    "default_shape": f"WITH {NL} SELECT name, year FROM nl WHERE year >= 2022",
    "public_shape": f"WITH {NL} SELECT id, name, year FROM nl WHERE year >= 2015 AND type_code = 'asp'",
    "units_of_law": f"WITH {NU} SELECT section_id, sort_key, position, depth FROM nu WHERE law_name = 'UK_ukpga_1987_5001'",
    "units_by_type": f"WITH {NU} SELECT section_id, law_name, text FROM nu WHERE section_type = 'heading'",
    "units_in_order": f"WITH {NU} SELECT section_id, sort_key, position FROM nu WHERE law_name = 'UK_uksi_2004_5002' ORDER BY sort_key, position, section_id LIMIT 50 OFFSET 25",
    "units_keyset": f"WITH {NU} SELECT law_name, section_id FROM nu WHERE law_name > 'UK_uksi' OR law_name = 'UK_uksi' AND section_id > '' ORDER BY law_name, section_id LIMIT 40",
    "annotations_by_type": f"WITH {NA} SELECT id, law_name, code FROM na WHERE code_type = 'amendment'",
    "facet_families": f"WITH {NL} SELECT DISTINCT family FROM nl WHERE family IS NOT NULL",
    "facet_years": f"WITH {NL} SELECT DISTINCT year FROM nl WHERE year IS NOT NULL",
    "facet_types": f"WITH {NL} SELECT DISTINCT type_code FROM nl WHERE type_code IS NOT NULL",
    "facet_statuses": f"WITH {NL} SELECT DISTINCT live FROM nl WHERE live IS NOT NULL",
    "section_counts": f"WITH {NU} SELECT section_type, count(*) AS n FROM nu GROUP BY 1",
    "code_counts": f"WITH {NA} SELECT code_type, count(*) AS n FROM na GROUP BY 1",
    "stats_row": f"SELECT (SELECT count(*) FROM lat) AS total_units, (SELECT count(DISTINCT {key_sql('law_name')}) FROM lat) AS laws_with_units, (SELECT count(*) FROM amendment_annotations) AS total_annotations, (SELECT count(DISTINCT {key_sql('law_name')}) FROM amendment_annotations) AS laws_with_annotations",
    "law_marks": f"WITH {NL} SELECT name, array_to_string(list_sort(map_keys(function)), '|') AS marks, CASE WHEN function IS NOT NULL THEN array_to_string(list_sort(list_filter(map_keys(function), lambda k: function[k])), '|') END AS true_marks FROM nl",
    "work_queue": f"{_QUEUE} SELECT * FROM q WHERE queue_reason IS NOT NULL",
    "work_queue_missing": f"{_QUEUE} SELECT law_name, queue_reason FROM q WHERE queue_reason = 'missing'",
    "work_queue_stale": f"{_QUEUE} SELECT law_name, law_updated_at, latest_unit_updated_at FROM q WHERE queue_reason = 'stale'",
    "work_queue_counts": f"{_QUEUE} SELECT count(*) AS total, count(*) FILTER (WHERE queue_reason = 'missing') AS missing_count, count(*) FILTER (WHERE queue_reason = 'stale') AS stale_count FROM q WHERE queue_reason IS NOT NULL",
    "client_queue": f"{_QUEUE}, c AS (SELECT name, CASE WHEN coalesce(unit_count, 0) = 0 THEN 'missing' WHEN nl.updated_at > latest_unit + INTERVAL 180 DAY THEN 'stale' END AS queue_reason FROM nl LEFT JOIN agg ON agg.law_id = nl.id) SELECT * FROM c WHERE queue_reason IS NOT NULL",
    "law_summary": f"{_SUMMARY} SELECT * FROM s",
    "law_summary_search": f"{_SUMMARY} SELECT * FROM s WHERE type_code = 'uksi' AND (title_en ILIKE '%tramway%' OR law_name ILIKE '%tramway%')",
    "incremental_units": f"WITH {NL}, {NU} SELECT section_id, law_name, nl.title_en AS law_title, nl.type_code AS law_type_code, nl.year AS law_year, nu.updated_at FROM nu JOIN nl ON nl.id = nu.law_id WHERE nu.updated_at >= TIMESTAMP '{SINCE}'",
    "incremental_annotations": f"WITH {NL}, {NA} SELECT na.id, law_name, nl.title_en AS law_title, code, na.updated_at FROM na JOIN nl ON nl.id = na.law_id WHERE na.updated_at >= TIMESTAMP '{SINCE}'",
    "incremental_by_law": f"WITH {NL}, {NU} SELECT section_id, law_name, nl.year AS law_year FROM nu JOIN nl ON nl.id = nu.law_id WHERE nu.updated_at >= TIMESTAMP '2022-01-01' AND law_name IN ('UK_ukpga_2013_5007', 'UK_asp_2009_5005')",
    "incremental_page": f"WITH {NL}, {NU} SELECT section_id, nu.updated_at FROM nu JOIN nl ON nl.id = nu.law_id WHERE nu.updated_at >= TIMESTAMP '{SINCE}' ORDER BY nu.updated_at, section_id LIMIT 500",
    "entries_queue": f"{_DOCS} SELECT law_name, field AS source_column, entry_no AS entry_index, article AS provision, lower(duty_type) AS kind, item AS holder, clause, confidence FROM entries WHERE confidence IS NULL OR confidence < 0.5",
    "json_values": "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events",
    "percentile_report": _PERCENTILES.format(k="event_type", src="SELECT event_type, value AS v FROM events"),
    "text_lengths": f"WITH {NU} " + _PERCENTILES.format(k="section_type", src="SELECT section_type, length(text) AS v FROM nu"),
    **{f"view_{v}": _view_sql(v) for v in views.VIEWS if v.startswith(("new_", "by_"))},
    **{f"group_{v}": _view_sql(v, "group") for v in ("new_last_3_years", "by_family", "by_status", "by_type", "by_extent")},
}
