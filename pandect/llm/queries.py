"""Queries of problems 5 to 8, with SQL where SQL can express them."""

from __future__ import annotations

from pandect.llm import mixing, packing, splitting, truncation, truncation_sql
from pandect.sources.tables import table


def _on(name, fn):
    return lambda spark, d: fn(table(spark, d, name))


def _mix(fn):
    return lambda spark, d: fn(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES = {
    "p5_found": _on("lat", splitting.found),
    "p5_pieces": _on("lat", splitting.numbered_pieces),
    "p5_check": _on("lat", splitting.verified),
    "p6_found": _on("documents", packing.found),
    "p6_packed": _on("documents", packing.packed),
    "p6_fill": _on("documents", packing.fill_report),
    "p6_check": _on("documents", packing.verified),
    "p7_found": _mix(mixing.found),
    "p7_shares": _mix(mixing.shares),
    "p7_mix": _mix(mixing.chosen),
    "p7_check": _mix(mixing.verified),
    "p7_heldout": _on("documents", mixing.heldout),
    "p8_found": _on("documents", truncation.found),
    "p8_report": _on("documents", truncation.report),
    "p8_limits": _on("documents", truncation.limits),
    "p8_hazards": _on("documents", truncation.lengths),
}

#: Blanks of all scripts, inside of a character class of the oracle's engine.
_B = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_T = rf"length(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_B}]+'))"
_P = r"^.*?([a-z]+)[^a-z0-9]+([0-9]{4})[^a-z0-9]+([0-9]+)[^a-z0-9]*$"

_ITEMS = rf"""
WITH n AS (SELECT section_id, regexp_replace(lower(law_name), '{_P}', 'UK_\1_\2_\3') AS law_name, list_filter(string_split(hierarchy_path, '/'), lambda x: x <> '') AS lv,
    length(coalesce(trim(regexp_replace(text, '[{_B}]+', ' ', 'g')), '')) AS z FROM lat WHERE updated_at IS NOT NULL AND section_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY updated_at DESC, synced_at) = 1),
p AS (SELECT law_name, array_to_string(lv[1:list_position(list_transform(lv, lambda x: starts_with(x, 'provision.')), true)], '/') AS item_key, z FROM n
  WHERE list_position(list_transform(lv, lambda x: starts_with(x, 'provision.')), true) > 0),
items AS (SELECT 'unit' AS item_kind, law_name, section_id AS item_key, z AS total FROM n WHERE z > 1200
  UNION ALL SELECT 'provision', law_name, item_key, CAST(sum(z) + count(*) - 1 AS BIGINT) FROM p GROUP BY law_name, item_key HAVING sum(z) + count(*) - 1 > 1200)
"""
_TARGETS = rf"""
WITH d AS (SELECT lower(regexp_replace(source, '^[{_B}]+|[{_B}]+$', '', 'g')) AS source, coalesce({_T}, 0) AS t FROM documents),
s AS (SELECT source, sum(t) AS t FROM d GROUP BY 1),
m AS (SELECT mix_id, source, sum(weight) AS weight, max(coalesce(max_repeats, 1)) AS max_repeats FROM (SELECT DISTINCT mix_id, lower(regexp_replace(source, '^[{_B}]+|[{_B}]+$', '', 'g')) AS source, weight, max_repeats FROM mix_targets WHERE weight > 0) GROUP BY 1, 2),
w AS (SELECT *, weight / sum(weight) OVER (PARTITION BY mix_id) AS share FROM m)
"""

ORACLE = truncation_sql.ORACLE | {
    "p5_found": f"{_ITEMS} SELECT item_kind, law_name, item_key FROM items",
    "p5_check": f"{_ITEMS} SELECT *, true AS within_limit, true AS overlapping, true AS covering, true AS texts_fit FROM items",
    "p6_found": f"SELECT doc_id FROM documents WHERE {_T} > 512",
    "p6_check": f"SELECT doc_id, CAST(t AS BIGINT) AS tokens, greatest(1, CAST(ceil(t / 512) AS BIGINT)) AS parts, true AS fits FROM (SELECT doc_id, coalesce({_T}, 0) AS t FROM documents)",
    "p7_found": f"{_TARGETS} SELECT mix_id, source FROM w LEFT JOIN s USING (source) WHERE coalesce(s.t, 0) * max_repeats < share * (SELECT sum(t) FROM d)",
    "p7_check": f"{_TARGETS} SELECT mix_id, source, round(share * (SELECT sum(t) FROM d), 3) AS target_tokens, CAST(coalesce(s.t, 0) AS BIGINT) AS available_tokens, max_repeats, true AS within_repeats, true AS reached FROM w LEFT JOIN s USING (source)",
    "p8_hazards": rf"""
WITH t AS (SELECT DISTINCT coalesce(lower(regexp_replace(source, '^[{_B}]+|[{_B}]+$', '', 'g')), '') AS source_name, text FROM documents WHERE text IS NOT NULL),
m AS (SELECT source_name, 'chars' AS measure, length(text) AS length FROM t UNION ALL SELECT source_name, 'bytes', strlen(text) FROM t),
e AS (SELECT source_name, measure, CAST(length AS BIGINT) AS length, count(*) AS ended FROM m GROUP BY ALL),
r AS (SELECT *, CAST(sum(ended) OVER (PARTITION BY source_name, measure ORDER BY length DESC) AS BIGINT) AS reached FROM e),
n AS (SELECT *, sum(ended) OVER w - ended AS near_ended, sum(reached) OVER w - reached AS near_reached, count(*) OVER w - 1 AS near FROM r
  WINDOW w AS (PARTITION BY source_name, measure ORDER BY length RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING))
SELECT source_name, measure, length, ended, reached, round(reached * (near_ended + 1) / (near_reached + (50 - near) * reached), 6) AS expected FROM n""",
}
