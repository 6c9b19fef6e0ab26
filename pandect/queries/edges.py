"""Links, cascades, change statistics, differences and merges, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pandect.operators import changes, edges, law_documents, register, shredding, views
from pandect.queries.problems import _DOCS
from pandect.queries.sql import NL, key_sql, strip_sql
from pandect.sources.tables import table

#: A day in the middle of the years of the amending laws, so that views of short periods hold some.
AS_OF = "2015-08-20"
LAW = ["title_en", "family", "live", "geo_extent", "function", "md_date", "amending", "amended_by", "linked_amending"]
DIFFED = ["title_en", "family", "live", "geo_extent", "md_date", "amending"]


def _laws(fn):
    return lambda spark, d: fn(register.laws(table(spark, d, "uk_lrt"), *LAW))


def _changes(fn):
    """Changes of each law by the laws that affect it, one row per detail."""

    def run(spark, d):
        nodes = law_documents.law_nodes(table(spark, d, "uk_lrt"))
        details = law_documents.detail_table(nodes)
        titles = law_documents.affecting_table(nodes).select("law_name", "item", "title")
        return fn(details.join(titles, ["law_name", "item"], "left"))

    return run


def _mark(name):
    return F.col("function")[name] == F.lit(True)


def _labels(x):
    return edges.function_labels(x, {"Amending": "amending", "Enacting": "linked_amending"}, _mark("Making"), _mark("Commencing")).select("name", F.array_join("labels", "|").alias("labels"))


def _cascade(x):
    seeds = x.where("family = 'RECORDS'").select("name")
    return edges.cascade(edges.edges(x, ["amending"]), seeds).select("name", "layer", F.array_join("sources", "|").alias("sources"))


def _diff(spark, d):
    two = edges.with_previous(table(spark, d, "uk_lrt"), "name", DIFFED).where("old_title_en is not null or old_md_date is not null")
    delta = changes.changed_fields(two, DIFFED)
    return two.select("name", delta.alias("c")).select("name", changes.summary(F.col("c")).alias("summary"), F.explode_outer("c").alias("field", "v")).select("name", "summary", "field", F.col("v.old").alias("old_value"), F.col("v.new").alias("new_value"), changes.kind_of_change(F.col("v.old"), F.col("v.new")).alias("kind"))


def _states(spark, d):
    """Two states of the register: of the laws seen by a time, and of those seen after it."""
    t = table(spark, d, "uk_lrt").select("name", "title_en", "family", "geo_extent", "function", "updated_at", "synced_at")
    early = register.laws(t.where("updated_at < timestamp_ntz'2022-06-01'"), "title_en", "family", "geo_extent", "function").drop("updated_at", "synced_at")
    late = register.laws(t.where("updated_at >= timestamp_ntz'2022-06-01'"), "title_en", "family", "geo_extent", "function").drop("updated_at", "synced_at")
    return early, late


def _flat(df):
    return df.select("name", "title_en", "family", "geo_extent", F.array_join(changes.from_marks(F.col("function")), "|").alias("marks"))


def _log(spark, d):
    return register.laws(table(spark, d, "uk_lrt"), "record_change_log").select("name", F.coalesce(F.size("record_change_log"), F.lit(0)).alias("n"), changes.log_summary(F.col("record_change_log")).alias("log"))


def _dated(spark, d):
    laws = register.laws(table(spark, d, "uk_lrt"), *LAW, "type_code")
    return edges.with_derived_dates(laws, law_documents.detail_table(law_documents.law_nodes(table(spark, d, "uk_lrt"))))


def _census(spark, d):
    nodes = law_documents.law_nodes(table(spark, d, "uk_lrt")).where("field <> 'affected_by_stats_per_law'")
    return shredding.census(nodes.where("node = 0"), ["field"]).select("field", "kind", "n")


def _element_counts(x):
    """Laws that refer to an existing law at all, and references per referred law of a type."""
    refs = edges.edges(x, ["amending", "amended_by"])
    known = refs.join(x.select(F.col("name").alias("dst")), "dst", "left_semi")
    return known.groupBy("kind", F.split("dst", "_")[1].alias("type")).agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("src").alias("n_laws"))


_DATED_VIEWS = [v for v in views.VIEWS if v.startswith(("amended_", "repealed_"))]
QUERIES = {
    **{f"view_{v}": lambda spark, d, v=v: views.build(_dated(spark, d), v, AS_OF) for v in _DATED_VIEWS},
    "derived_dates": lambda spark, d: _dated(spark, d).select("name", "latest_amend_date", "latest_rescind_date"),
    "json_census": _census,
    "element_counts": _laws(_element_counts),
    "law_edges": _laws(lambda x: edges.edges(x, ["amending", "amended_by", "linked_amending"])),
    "latest_related_date": _laws(lambda x: edges.latest_related_date(x, "amended_by")),
    "dependants_of_changed": _laws(lambda x: edges.dependants(x, x.where("md_date >= date'2015-01-01'").select("name"), "amended_by")),
    "derived_dates_of_dependants": _laws(lambda x: edges.latest_related_date(x, "amended_by", only=edges.dependants(x, x.where("md_date >= date'2015-01-01'").select("name"), "amended_by"))),
    "resolved_links": _laws(lambda x: edges.resolved(x, "amending").select("name", F.array_join("links", "|").alias("links"))),
    "exists_partition": _laws(lambda x: edges.known_and_unknown(x, "amended_by")),
    "reversed_lists": _laws(lambda x: edges.reversed_lists(x, "amending", _mark("Making")).select("name", F.array_join("referrers", "|").alias("referrers"), "any_flag")),
    "function_labels": _laws(_labels),
    "cascade_layers": _laws(_cascade),
    "change_stats": _changes(edges.change_stats),
    "ordered_links": _changes(lambda c: edges.ordered_links(c).select("law_name", F.array_join("links", "|").alias("links"))),
    "stats_per_law": _changes(lambda c: edges.stats_map(c).select("law_name", F.explode("stats").alias("k", "s")).select("law_name", "s.name", "s.title", "s.count", F.size("s.details").cast("bigint").alias("n_details"))),
    "change_lines": _changes(lambda c: c.select("law_name", "item", "detail_no", edges.change_line(F.col("target"), F.col("affect"), F.col("applied")).alias("line"))),
    "self_changes": _changes(lambda c: edges.self_change_text(c.withColumn("item", F.col("law_name")))),
    "reconciled_status": lambda spark, d: register.laws(table(spark, d, "uk_lrt"), "live").join(_changes(edges.change_stats)(spark, d).select(F.col("law_name").alias("name"), F.col("status").alias("s")), "name").select("name", edges.reconciled_status(F.col("live"), F.col("s")).alias("r")).select("name", "r.status", "r.source", "r.conflict"),
    "record_diff": _diff,
    "change_log_summary": _log,
    "merge_upsert": lambda spark, d: _flat(changes.upsert(*_states(spark, d), ["name"])),
    "merge_overwrite": lambda spark, d: _flat(changes.merged(*_states(spark, d), ["name"], "overwrite_non_empty")),
    "merge_fill": lambda spark, d: _flat(changes.merged(*_states(spark, d), ["name"], "fill_missing")),
    "merge_replace_groups": lambda spark, d: _flat(changes.replace_groups(*_states(spark, d), ["family"])),
    "merge_delete": lambda spark, d: _flat(changes.without_keys(_states(spark, d)[0], table(spark, d, "removed_keys").where("table_name = 'uk_lrt'").select(F.col("record_key").alias("name")), ["name"])),
    "merge_mark": _laws(lambda x: changes.mark(x, "family", F.col("live").isNull(), "_todo").select("name", "family")),
    "prepended_lists": _laws(lambda x: x.select("name", F.array_join(changes.prepended(F.col("amending"), F.col("amended_by")), "|").alias("merged"))),
    "value_forms": _laws(lambda x: x.select("name", F.to_json(changes.as_values(changes.from_marks(F.col("function")))).alias("as_values"), F.size(changes.as_marks(F.col("amending"))).cast("bigint").alias("n_marks"))),
    "split_values": _laws(lambda x: x.select("name", *[F.array_join(c, "|").alias(n) for c, n in zip(changes.split_by_membership(changes.from_marks(F.col("function")), ["Making", "Amending"]), ("members", "others"), strict=True)])),
}

_EDGES = f"WITH {NL}, e AS (SELECT DISTINCT src, dst, kind FROM (" + " UNION ALL ".join(f"SELECT src, {key_sql('x')} AS dst, '{k}' AS kind FROM (SELECT name AS src, unnest({k}) AS x FROM nl)" for k in ("amending", "amended_by", "linked_amending")) + ") WHERE dst IS NOT NULL)"
_DEP = "dep AS (SELECT DISTINCT src AS name FROM e WHERE kind = 'amended_by' AND dst IN (SELECT name FROM nl WHERE md_date >= DATE '2015-01-01'))"
_CHANGES = f"{_DOCS}, ch AS (SELECT law_name, item, detail_no, x.target AS target, x.affect AS affect, x.applied AS applied FROM detail WHERE x IS NOT NULL), lo AS (SELECT *, coalesce(lower(affect), '') AS l FROM ch), fl AS (SELECT *, item = law_name AS own, contains(l, 'repeal') OR contains(l, 'revoke') AS gone, contains(l, 'in full') OR contains(l, 'repeal') AND NOT contains(l, 'in part') AS fully FROM lo)"
_STATS = f"""{_CHANGES}, cs AS (SELECT law_name, count(*) AS total_changes, count(*) FILTER (WHERE NOT own AND NOT gone) AS amendments, count(*) FILTER (WHERE NOT own AND gone) AS revocations, count(DISTINCT item) FILTER (WHERE NOT own) AS laws,
  count(DISTINCT item) FILTER (WHERE NOT own AND NOT gone) AS amending_laws, count(DISTINCT item) FILTER (WHERE NOT own AND gone) AS revoking_laws, count(*) FILTER (WHERE own) AS self_changes,
  CASE WHEN count(*) FILTER (WHERE NOT own AND gone) = 0 THEN '✔ In force' WHEN bool_or(NOT own AND gone AND fully) THEN '❌ Revoked / Repealed / Abolished' ELSE '⭕ Part Revocation / Repeal' END AS status FROM fl GROUP BY 1)"""
_LINE = "CASE WHEN coalesce(target, '') = '' AND coalesce(affect, '') = '' THEN NULL WHEN coalesce(target, '') = '' THEN affect || ' [' || coalesce(applied, '') || ']' WHEN coalesce(affect, '') = '' THEN target ELSE target || ' ' || affect || ' [' || coalesce(applied, '') || ']' END"


def _state_sql(where: str) -> str:
    return f"SELECT name, title_en, family, geo_extent, function FROM uk_lrt WHERE updated_at {where} TIMESTAMP '2022-06-01' AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, synced_at) = 1"


_STATES = f"WITH a AS ({_state_sql('<')}), b AS ({_state_sql('>=')})"
_MARKS = "coalesce(array_to_string(list_sort(list_filter(map_keys({m}), lambda k: {m}[k])), '|'), '')"


def _flat_sql(src: str) -> str:
    return f"SELECT name, title_en, family, geo_extent, CASE WHEN function IS NOT NULL THEN {_MARKS.format(m='function')} END AS marks FROM {src}"


def _field(a: str, b: str, c: str) -> str:
    return f"coalesce(nullif({strip_sql(f'{a}.{c}')}, ''), nullif({strip_sql(f'{b}.{c}')}, '')) AS {c}"


def _merge_sql(first: str, second: str) -> str:
    fields = ", ".join(_field(first, second, c) for c in ("title_en", "family", "geo_extent"))
    keys = f"list_sort(list_distinct(list_concat(list_filter(coalesce(map_keys({first}.function), []), lambda k: {first}.function[k]), list_filter(coalesce(map_keys({second}.function), []), lambda k: {second}.function[k] AND NOT list_contains(coalesce(map_keys({first}.function), []), k)))))"
    return f"{_STATES} SELECT coalesce(a.name, b.name) AS name, {fields}, CASE WHEN a.function IS NOT NULL OR b.function IS NOT NULL THEN array_to_string({keys}, '|') END AS marks FROM a FULL JOIN b ON a.name = b.name"


def _diff_sql() -> str:
    texts = {c: f"nullif({strip_sql('{p}' + c)}, '')" for c in ("title_en", "family", "live", "geo_extent")}
    texts["md_date"] = "strftime({p}md_date, '%Y-%m-%d')"
    texts["amending"] = "CASE WHEN len({p}amending) > 0 THEN replace(to_json({p}amending)::VARCHAR, ', ', ',') END"
    at = lambda t, prefix: t.replace("{p}", prefix)
    rows = " UNION ALL ".join(f"SELECT name, '{c}' AS field, {at(t, 'o_')} AS old_value, {at(t, '')} AS new_value FROM t" for c, t in texts.items())
    return f"""WITH v AS (SELECT * FROM uk_lrt WHERE updated_at IS NOT NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name, updated_at ORDER BY synced_at) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY updated_at DESC) AS r FROM v),
t AS (SELECT n.name, n.title_en, n.family, n.live, n.geo_extent, n.md_date, n.amending, o.title_en AS o_title_en, o.family AS o_family, o.live AS o_live, o.geo_extent AS o_geo_extent, o.md_date AS o_md_date, o.amending AS o_amending
  FROM r n JOIN r o ON n.name = o.name AND n.r = 1 AND o.r = 2 WHERE o.title_en IS NOT NULL OR o.md_date IS NOT NULL),
d AS (SELECT * FROM ({rows}) WHERE old_value IS DISTINCT FROM new_value),
s AS (SELECT name, 'Updated ' || count(*) || CASE WHEN count(*) = 1 THEN ' field: ' ELSE ' fields: ' END || string_agg(field, ', ' ORDER BY field) AS summary FROM d GROUP BY 1)
SELECT t.name, coalesce(summary, 'No changes') AS summary, field, old_value, new_value, CASE WHEN field IS NULL THEN NULL WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM t LEFT JOIN s ON s.name = t.name LEFT JOIN d ON d.name = t.name"""


_DATED = f"""{_CHANGES}, raw AS (SELECT name AS src, unnest(amended_by) AS x FROM nl), am AS (SELECT DISTINCT src, {key_sql("x")} AS dst FROM raw), ad AS (SELECT src, max(md_date) AS latest_amend_date FROM am JOIN nl ON nl.name = dst GROUP BY 1),
rd AS (SELECT law_name AS src, max(md_date) AS latest_rescind_date FROM (SELECT DISTINCT law_name, item FROM fl WHERE gone AND NOT own) JOIN nl ON nl.name = item GROUP BY 1),
dated AS (SELECT nl.name, title_en, type_code, live, family, latest_amend_date, latest_rescind_date FROM nl LEFT JOIN ad ON ad.src = nl.name LEFT JOIN rd ON rd.src = nl.name)"""


def _view_sql(name: str) -> str:
    v, at = views.VIEWS[name], views.calendar(AS_OF)
    live = ", ".join(f"'{x}'" for x in v.statuses)
    end = f"AND {v.date} < DATE '{at[v.end]}'" if v.end else ""
    return f"{_DATED} SELECT name, title_en, type_code, live, family, {v.date}, CAST(year({v.date}) AS INT) AS {v.date}_year, CAST(month({v.date}) AS INT) AS {v.date}_month FROM dated WHERE {v.date} > DATE '{at[v.start]}' {end} AND live IN ({live})"


ORACLE = {
    **{f"view_{v}": _view_sql(v) for v in _DATED_VIEWS},
    "derived_dates": f"{_DATED} SELECT name, latest_amend_date, latest_rescind_date FROM dated",
    "json_census": f"{_DOCS} SELECT field, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'string' END AS kind, count(*) AS n FROM opened GROUP BY 1, 2",
    "element_counts": f"{_EDGES} SELECT kind, string_split(dst, '_')[2] AS type, count(*) AS n_refs, count(DISTINCT src) AS n_laws FROM e WHERE kind <> 'linked_amending' AND dst IN (SELECT name FROM nl) GROUP BY 1, 2",
    "law_edges": f"{_EDGES} SELECT * FROM e",
    "latest_related_date": f"{_EDGES} SELECT nl.name, max(o.md_date) AS latest FROM nl LEFT JOIN e ON e.src = nl.name AND kind = 'amended_by' LEFT JOIN nl o ON o.name = e.dst GROUP BY 1",
    "dependants_of_changed": f"{_EDGES}, {_DEP} SELECT * FROM dep",
    "derived_dates_of_dependants": f"{_EDGES}, {_DEP} SELECT dep.name, max(o.md_date) AS latest FROM dep LEFT JOIN e ON e.src = dep.name AND kind = 'amended_by' LEFT JOIN nl o ON o.name = e.dst GROUP BY 1",
    "resolved_links": f"{_EDGES}, g AS (SELECT src, string_agg(dst, '|' ORDER BY dst) AS links FROM e WHERE kind = 'amending' AND dst IN (SELECT name FROM nl) GROUP BY 1) SELECT name, coalesce(links, '') AS links FROM nl LEFT JOIN g ON g.src = name",
    "exists_partition": f"{_EDGES}, g AS (SELECT dst, count(DISTINCT src) AS referrers FROM e WHERE kind = 'amended_by' GROUP BY 1) SELECT dst AS name, referrers, nl.name IS NOT NULL AS known, title_en AS title FROM g LEFT JOIN nl ON nl.name = dst",
    "reversed_lists": f"{_EDGES} SELECT dst AS name, string_agg(src, '|' ORDER BY src) AS referrers, bool_or(coalesce(function['Making'] = true, false)) AS any_flag FROM e JOIN nl ON nl.name = src WHERE kind = 'amending' GROUP BY 1",
    "function_labels": f"""{_EDGES}, l AS (SELECT name, 'Making' AS label FROM nl WHERE function['Making'] = true UNION SELECT name, 'Commencing' FROM nl WHERE function['Commencing'] = true
      UNION SELECT src, CASE kind WHEN 'amending' THEN 'Amending' ELSE 'Enacting' END || CASE WHEN coalesce(function['Making'] = true, false) THEN ' Maker' ELSE '' END FROM e LEFT JOIN nl ON nl.name = dst WHERE kind <> 'amended_by')
      SELECT nl.name, coalesce(string_agg(label, '|' ORDER BY label), '') AS labels FROM nl LEFT JOIN l ON l.name = nl.name GROUP BY 1""",
    "cascade_layers": f"""{_EDGES}, k AS (SELECT src, dst FROM e WHERE kind = 'amending' AND src <> dst), s0 AS (SELECT name FROM nl WHERE family = 'RECORDS'),
      l1 AS (SELECT dst AS name, string_agg(src, '|' ORDER BY src) AS sources FROM k WHERE src IN (FROM s0) AND dst NOT IN (FROM s0) GROUP BY 1),
      l2 AS (SELECT dst AS name, string_agg(src, '|' ORDER BY src) AS sources FROM k WHERE src IN (SELECT name FROM l1) AND dst NOT IN (FROM s0) AND dst NOT IN (SELECT name FROM l1) GROUP BY 1),
      l3 AS (SELECT dst AS name, string_agg(src, '|' ORDER BY src) AS sources FROM k WHERE src IN (SELECT name FROM l2) AND dst NOT IN (FROM s0) AND dst NOT IN (SELECT name FROM l1) AND dst NOT IN (SELECT name FROM l2) GROUP BY 1)
      SELECT name, CAST(1 AS INT) AS layer, sources FROM l1 UNION ALL SELECT name, 2, sources FROM l2 UNION ALL SELECT name, 3, sources FROM l3""",
    "change_stats": f"{_STATS} SELECT * FROM cs",
    "ordered_links": f"{_CHANGES}, i AS (SELECT DISTINCT law_name, item, coalesce(TRY_CAST(regexp_extract(item, '_([0-9]{{4}})_([0-9]+)$', 1) AS BIGINT), 0) AS y, coalesce(TRY_CAST(regexp_extract(item, '_([0-9]{{4}})_([0-9]+)$', 2) AS BIGINT), 0) AS n FROM ch) SELECT law_name, string_agg(item, '|' ORDER BY y DESC, n DESC, item) AS links FROM i GROUP BY 1",
    "stats_per_law": f"{_CHANGES}, w AS (SELECT law_name, item, count(*) AS n, count(DISTINCT CASE WHEN coalesce(nullif(target, ''), nullif(affect, '')) IS NOT NULL THEN coalesce(target, '~') || '#' || coalesce(affect, '~') || '#' || coalesce(applied, '~') END) AS nd FROM ch GROUP BY 1, 2) SELECT w.law_name, w.item AS name, stat.s.title AS title, n AS count, nd AS n_details FROM w JOIN stat USING (law_name, item)",
    "change_lines": f"{_CHANGES} SELECT law_name, item, CAST(detail_no AS INT) AS detail_no, {_LINE} AS line FROM ch",
    "self_changes": f"{_CHANGES}, g AS (SELECT law_name, count(*) AS n, list_sort(list(DISTINCT {_LINE}) FILTER (WHERE {_LINE} IS NOT NULL)) AS l FROM ch GROUP BY 1) SELECT law_name, array_to_string(list_concat([n || ' self-amendments'], list_transform(coalesce(l, []), lambda x: ' ' || x)), chr(10)) AS detail FROM g",
    "reconciled_status": f"""{_STATS}, v AS (SELECT name, live, status, CASE status WHEN '✔ In force' THEN 1 WHEN '⭕ Part Revocation / Repeal' THEN 2 ELSE 3 END AS a, CASE live WHEN '✔ In force' THEN 1 WHEN '⭕ Part Revocation / Repeal' THEN 2 WHEN '❌ Revoked / Repealed / Abolished' THEN 3 ELSE 0 END AS b FROM nl JOIN cs ON cs.law_name = nl.name)
      SELECT name, CASE WHEN a > b THEN status ELSE live END AS status, CASE WHEN a > b THEN 'changes' WHEN b > a THEN 'register' ELSE 'both' END AS source, a <> b AS conflict FROM v""",
    "record_diff": _diff_sql(),
    "change_log_summary": "WITH n AS (SELECT name, record_change_log AS l FROM uk_lrt WHERE updated_at IS NOT NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, synced_at) = 1) SELECT name, CAST(coalesce(len(l), 0) AS INT) AS n, CASE WHEN coalesce(len(l), 0) > 0 THEN len(l) || CASE WHEN len(l) = 1 THEN ' update since ' ELSE ' updates since ' END || coalesce(left(l[1].\"timestamp\", 10), '') ELSE 'No change history' END AS log FROM n",
    "merge_upsert": f"{_STATES} {_flat_sql('(SELECT * FROM b UNION ALL SELECT * FROM a WHERE name NOT IN (SELECT name FROM b))')}",
    "merge_overwrite": _merge_sql("b", "a"),
    "merge_fill": _merge_sql("a", "b"),
    "merge_replace_groups": f"{_STATES} {_flat_sql('(SELECT * FROM b UNION ALL SELECT * FROM a WHERE family IS NULL OR family NOT IN (SELECT family FROM b WHERE family IS NOT NULL))')}",
    "merge_delete": f"{_STATES} {_flat_sql('''(SELECT * FROM a WHERE name NOT IN (SELECT record_key FROM removed_keys WHERE table_name = 'uk_lrt'))''')}",
    "merge_mark": f"WITH {NL} SELECT name, CASE WHEN live IS NULL THEN '_todo' ELSE family END AS family FROM nl",
    "prepended_lists": f"WITH {NL} SELECT name, array_to_string(list_concat(list_filter(m, lambda x: x IS NOT NULL), coalesce(amending, [])), '|') AS merged FROM (SELECT name, amending, coalesce((SELECT list(x ORDER BY o) FROM (SELECT x, min(o) AS o FROM (SELECT unnest(amended_by) AS x, generate_subscripts(amended_by, 1) AS o) GROUP BY x) WHERE x IS NOT NULL AND NOT list_contains(coalesce(amending, []), x)), []) AS m FROM nl)",
    "value_forms": f"WITH {NL} SELECT name, CASE WHEN function IS NOT NULL THEN replace(to_json({{'values': list_sort(list_filter(map_keys(function), lambda k: function[k]))}})::VARCHAR, ', ', ',') END AS as_values, CAST(len(list_distinct(amending)) AS BIGINT) AS n_marks FROM nl",
    "split_values": f"WITH {NL}, m AS (SELECT name, function, list_sort(list_filter(map_keys(function), lambda k: function[k])) AS l FROM nl) SELECT name, CASE WHEN function IS NOT NULL THEN array_to_string(list_filter(l, lambda x: x IN ('Making', 'Amending')), '|') END AS members, CASE WHEN function IS NOT NULL THEN array_to_string(list_filter(l, lambda x: x NOT IN ('Making', 'Amending')), '|') END AS others FROM m",
}
