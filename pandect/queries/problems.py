"""Queries of problems 1 to 4, with the same results in ANSI SQL."""

from __future__ import annotations

from pandect.operators import law_documents, law_references, law_status, law_totals
from pandect.queries.sql import B, key_sql
from pandect.sources.tables import table


def _p1(fn):
    return lambda spark, d: fn(table(spark, d, "uk_lrt"), table(spark, d, "live_statuses"))


def _p2(fn):
    return lambda spark, d: fn(*[table(spark, d, t) for t in ("uk_lrt", "lat", "amendment_annotations", "removed_keys")])


def _p3(fn):
    return lambda spark, d: fn(table(spark, d, "lat"), table(spark, d, "amendment_annotations"))


def _p4(fn):
    return lambda spark, d: fn(table(spark, d, "uk_lrt"))


QUERIES = {
    "p1_found": _p1(law_status.found),
    "p1_history": _p1(law_status.periods),
    "p1_descent": _p1(law_status.descent),
    "p2_found": _p2(law_references.found),
    "p2_report": _p2(law_references.report),
    "p2_masks": _p2(law_references.masks),
    "p3_found": _p3(law_totals.heavy),
    "p3_law_totals": _p3(law_totals.law_totals),
    "p4_found": _p4(law_documents.found),
    "p4_entries": _p4(lambda laws: law_documents.entry_table(law_documents.law_nodes(laws)).drop("node", "parent")),
    "p4_affecting": _p4(lambda laws: law_documents.affecting_table(law_documents.law_nodes(laws)).drop("node")),
    "p4_details": _p4(lambda laws: law_documents.detail_table(law_documents.law_nodes(laws))),
}

_OBSERVED = r"""
st AS (SELECT regexp_replace(lower(label), '[^\p{L}]', '', 'g') AS k, min(status_code) AS status_code FROM live_statuses GROUP BY 1),
logs AS (SELECT name, unnest(record_change_log) AS e FROM uk_lrt),
changed AS (SELECT name, e."timestamp" AS ts, e.changes['live']."new" AS v FROM logs),
parsed AS (SELECT name, CASE WHEN regexp_matches(ts, '^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}') THEN
    CASE WHEN regexp_matches(ts, '[+-]\d{2}:\d{2}$') THEN
        CAST(left(trim(ts), -6) AS TIMESTAMP) - CAST(CASE WHEN left(right(ts, 6), 1) = '-' THEN -1 ELSE 1 END * (CAST(right(left(ts, -3), 2) AS INT) * 60 + CAST(right(ts, 2) AS INT)) AS INT) * INTERVAL 1 MINUTE
    ELSE CAST(rtrim(trim(ts), 'Z') AS TIMESTAMP) END END AS seen,
    CASE WHEN v LIKE '"%' AND json_valid(v) THEN json_extract_string(v, '$') ELSE v END AS v FROM changed),
obs AS (SELECT DISTINCT name, seen, status_code FROM (
    SELECT name, updated_at AS seen, regexp_replace(lower(live), '[^\p{L}]', '', 'g') AS k FROM uk_lrt
    UNION ALL SELECT name, seen, regexp_replace(lower(v), '[^\p{L}]', '', 'g') FROM parsed) o JOIN st USING (k) WHERE seen IS NOT NULL AND name IS NOT NULL),
marked AS (SELECT *, lag(status_code) OVER (PARTITION BY name ORDER BY seen, status_code) AS was FROM obs),
starts AS (SELECT name, seen, status_code, lead(seen) OVER (PARTITION BY name ORDER BY seen, status_code) AS until FROM marked WHERE was IS NULL OR was <> status_code)
"""

_NEWEST_LAW = "nl AS (SELECT * FROM uk_lrt WHERE updated_at IS NOT NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, synced_at) = 1)"

_ORPHANS = f"""
WITH {_NEWEST_LAW},
na AS (SELECT * FROM amendment_annotations WHERE updated_at IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, synced_at) = 1),
raw AS (
  SELECT 'uk_lrt' AS source_table, name AS source_key, 'amending' AS field, unnest(amending) AS x, updated_at, synced_at FROM nl
  UNION ALL SELECT 'uk_lrt', name, 'amended_by', unnest(amended_by), updated_at, synced_at FROM nl
  UNION ALL SELECT 'uk_lrt', name, 'linked_amending', unnest(linked_amending), updated_at, synced_at FROM nl),
refs AS (SELECT DISTINCT * FROM (
  SELECT source_table, source_key, field, {key_sql("x")} AS ref_key, updated_at, synced_at, 'uk_lrt' AS target FROM raw
  UNION ALL SELECT 'amendment_annotations', id, 'affected_sections', nullif(regexp_replace(x, '^[{B}]+|[{B}]+$', '', 'g'), ''), updated_at, synced_at, 'lat'
  FROM (SELECT id, unnest(affected_sections) AS x, updated_at, synced_at FROM na)) WHERE ref_key IS NOT NULL),
recs AS (SELECT target, k, min(synced_at) AS first_in, max(synced_at) AS last_in FROM (
  SELECT 'uk_lrt' AS target, name AS k, synced_at FROM uk_lrt UNION ALL SELECT 'lat', section_id, synced_at FROM lat) WHERE k IS NOT NULL GROUP BY 1, 2),
gone AS (SELECT table_name AS target, record_key AS k, max(removed_at) AS gone_at FROM removed_keys WHERE removed_at IS NOT NULL GROUP BY 1, 2),
judged AS (SELECT r.*, CASE WHEN g.gone_at IS NOT NULL AND (c.last_in IS NULL OR c.last_in <= g.gone_at) THEN 'deleted'
    WHEN c.k IS NULL THEN 'missing' WHEN c.first_in > r.synced_at THEN 'late' END AS kind
  FROM refs r LEFT JOIN recs c ON c.target = r.target AND c.k = r.ref_key LEFT JOIN gone g ON g.target = r.target AND g.k = r.ref_key),
orphan AS (SELECT DISTINCT source_table, source_key, field, ref_key, kind, strftime(updated_at, '%Y-%m') AS period FROM judged WHERE kind IS NOT NULL)
"""

_LAWS = f"""
WITH items AS (SELECT DISTINCT 'lat' AS table_name, section_id AS k, {key_sql("law_name")} AS law_name FROM lat WHERE section_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'amendment_annotations', id, {key_sql("law_name")} FROM amendment_annotations WHERE id IS NOT NULL),
whole AS (SELECT table_name, count(DISTINCT k) AS n FROM items GROUP BY 1),
per AS (SELECT table_name, law_name, count(DISTINCT k) AS items FROM items WHERE law_name IS NOT NULL GROUP BY 1, 2)
"""

_SIZES = rf"""
, sized AS (SELECT table_name, k, z FROM (
  SELECT 'lat' AS table_name, section_id AS k, length(trim(regexp_replace(text, '[{B}]+', ' ', 'g'))) AS z, row_number() OVER (PARTITION BY section_id ORDER BY updated_at DESC, synced_at) AS rn FROM lat WHERE updated_at IS NOT NULL
  UNION ALL SELECT 'amendment_annotations', id, length(trim(regexp_replace(text, '[{B}]+', ' ', 'g'))), row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, synced_at) FROM amendment_annotations WHERE updated_at IS NOT NULL) WHERE rn = 1),
chars AS (SELECT table_name, law_name, coalesce(sum(z), 0) AS characters FROM items LEFT JOIN sized USING (table_name, k) WHERE law_name IS NOT NULL GROUP BY 1, 2)
"""

_DOCS = rf"""
WITH {_NEWEST_LAW},
doc AS (SELECT name AS law_name, 'duty_holder' AS field, 'holder' AS own, duty_holder AS t FROM nl UNION ALL SELECT name, 'popimar', 'category', popimar FROM nl),
ok AS (SELECT law_name, field, own, CAST(t AS JSON) AS j FROM doc WHERE t IS NOT NULL AND json_valid(t) AND trim(t) <> ''),
opened AS (SELECT law_name, field, own, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM ok),
entry AS (SELECT law_name, field, own, unnest(from_json(json_extract(j, '$.entries'), '["JSON"]')) AS e, generate_subscripts(from_json(json_extract(j, '$.entries'), '["JSON"]'), 1) AS entry_no
  FROM opened WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.entries') = 'ARRAY'),
entries AS (SELECT law_name, field, CAST(entry_no AS INT) AS entry_no, nullif(regexp_replace(CASE WHEN own = 'holder' THEN e ->> '$.holder' ELSE e ->> '$.category' END, '^[{B}]+|[{B}]+$', '', 'g'), '') AS item,
  e ->> '$.duty_type' AS duty_type, e ->> '$.clause' AS clause, e ->> '$.article' AS article, CAST(e ->> '$.regex_clause_confidence' AS DOUBLE) AS confidence FROM entry WHERE json_type(e) = 'OBJECT'),
listed AS (
  SELECT law_name, field, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["VARCHAR"]') ELSE list_concat(list_concat(
    coalesce(from_json(json_extract(j, '$.holders'), '["VARCHAR"]'), []), coalesce(from_json(json_extract(j, '$.categories'), '["VARCHAR"]'), [])), coalesce(from_json(json_extract(j, '$.values'), '["VARCHAR"]'), [])) END) AS item
  FROM opened WHERE json_type(j) IN ('ARRAY', 'OBJECT')
  UNION ALL SELECT law_name, field, k FROM (SELECT law_name, field, j, unnest(json_keys(j)) AS k FROM opened WHERE json_type(j) = 'OBJECT') WHERE (j -> k)::VARCHAR = 'true' AND k NOT IN ('entries', 'holders', 'categories', 'values', 'articles')
  UNION ALL SELECT law_name, field, item FROM entries),
stat AS (SELECT name AS law_name, 'affected_by_stats_per_law' AS field, unnest(map_keys(affected_by_stats_per_law)) AS item, unnest(map_values(affected_by_stats_per_law)) AS s FROM nl),
detail AS (SELECT law_name, field, item, unnest(s.details) AS x, generate_subscripts(s.details, 1) AS detail_no FROM stat)
"""

ORACLE = {
    "p1_found": f"WITH {_OBSERVED} SELECT DISTINCT name AS law_name, strftime(seen, '%Y-%m-%d %H:%M:%S') AS valid_from, status_code FROM starts",
    "p1_history": f"WITH {_OBSERVED} SELECT name AS law_name, status_code, strftime(seen, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(until, '%Y-%m-%d %H:%M:%S'), '') AS valid_to, until IS NULL AS is_current FROM starts",
    "p2_found": f"{_ORPHANS} SELECT * FROM orphan",
    "p2_report": f"{_ORPHANS} SELECT source_table, field, kind, period, count(*) AS orphans FROM orphan GROUP BY ALL",
    "p2_masks": f"""{_ORPHANS} SELECT source_table, field, concat_ws(',',
    CASE WHEN target = 'lat' OR NOT regexp_matches(lower(ref_key), '([a-z]+)[^a-z0-9]+([0-9]{{4}})[^a-z0-9]*([^a-z0-9][0-9]+[^a-z0-9]*)?$') THEN 'type' END,
    CASE WHEN target = 'lat' OR NOT regexp_matches(lower(ref_key), '[a-z][^a-z0-9]+[0-9]{{4}}[^a-z0-9]*$|(^|[^a-z0-9])[0-9]{{4}}[^a-z0-9]+[0-9]+[^a-z0-9]*$') THEN 'year' END,
    CASE WHEN target = 'lat' OR NOT regexp_matches(lower(ref_key), '(^|[^a-z0-9])[0-9]{{4}}[^a-z0-9]+[0-9]+[^a-z0-9]*$') THEN 'number' END,
    CASE WHEN target <> 'lat' AND regexp_matches(lower(ref_key), '[a-z][^a-z0-9]+[0-9]{{4}}[^a-z0-9]*$|(^|[^a-z0-9])[0-9]{{4}}[^a-z0-9]+[0-9]+[^a-z0-9]*$') THEN 'text' END) AS null_keys, count(*) AS "references" FROM refs GROUP BY ALL""",
    "p3_found": f"{_LAWS} SELECT table_name, law_name FROM per JOIN whole USING (table_name) WHERE items * 100 >= n * 4",
    "p3_law_totals": f"{_LAWS} {_SIZES} SELECT table_name, law_name, items, CAST(characters AS BIGINT) AS characters, round(items / n, 6) AS share FROM per JOIN whole USING (table_name) JOIN chars USING (table_name, law_name)",
    "p4_found": rf"""{_DOCS} SELECT DISTINCT law_name, field, regexp_replace(item, '^[{B}]+|[{B}]+$', '', 'g') AS item_key, CAST(0 AS INT) AS child_no FROM listed WHERE regexp_replace(item, '[{B}]+', '', 'g') <> ''
UNION ALL SELECT law_name, field, item, entry_no FROM entries WHERE item IS NOT NULL
UNION ALL SELECT law_name, field, item, CAST(0 AS INT) FROM stat UNION ALL SELECT law_name, field, item, CAST(detail_no AS INT) FROM detail WHERE x IS NOT NULL""",
    "p4_entries": f"{_DOCS} SELECT * FROM entries",
    "p4_affecting": f"{_DOCS} SELECT law_name, field, item, s.name AS affecting_name, s.title AS title, s.url AS url, s.count AS n_changes FROM stat",
    "p4_details": f"{_DOCS} SELECT law_name, field, item, CAST(detail_no AS INT) AS detail_no, x.target AS target, x.affect AS affect, x.applied AS applied FROM detail WHERE x IS NOT NULL",
}
