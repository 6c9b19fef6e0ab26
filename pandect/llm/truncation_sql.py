"""SQL with the results of ``truncation``, for an engine without look-around."""

from __future__ import annotations

from pandect.llm import truncation as T

#: Blanks of all scripts, inside of a character class of the oracle's engine.
_B = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_I = T._INNER


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{_q(pattern)}')"


_ANY = {k: T._any(k) for k in T.WORDS}
_STOP = f"[{T._STOPS}]"
_END = f"{_STOP}[{T._CLOSE}]*"
_MARKS = _q(rf"(?:</?[A-Za-z][^<>]*>|[{_B}{T._ZERO}…>\"”]|\.\.\.+|\[(?:…|\.\.\.|more)\]|\((?:cont\.?|continued|…|\.\.\.)\))+$")
_NOTES = _q(rf"(?:[{_B}]+|\[[A-Z]?\d+\]|\(\d+\)|\*+|[—–-]|\(see [^()]*\)|[Ee]nd of document\.?|\b[A-Z]\d+)+$")
_PLAIN = T._PLAIN.replace(r"\z", "$")


def _stem(x: str) -> str:
    """Without notes, leaders and again notes behind the last sentence."""
    leaders = r"(\.)(?: \.)+ ?(?:[A-Z]?\d+)?$"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '{_NOTES}', ''), '{leaders}', '\\1'), '{_NOTES}', '')"


_ABBREVIATED = rf"(?:^|[^\p{{L}}]){_ANY['abbreviation']}\.$|\b{_ANY['date']} \d{{1,2}}(?:\.\d{{1,2}})?\.$"
_DECIMAL = rf"\b{_ANY['copula']} \d+\.$"
_MONEY = r"[£$€]\d[\d,]*\.$"
_RUNS_ON = rf"{_END} +[\p{{Lu}}“\"(]"
_BULLETS = T._BULLETS.replace(r"\A", "^").replace(r"\z", "$")
_BARS = "length({0}) - length(replace({0}, '|', ''))"

_HEADING = " AND ".join(
    [
        f"len(string_split(line, ' ')) <= {T.HEADING_WORDS}",
        "NOT (contains(line, '|') AND contains(core, chr(10)))",
        f"NOT {_has('line', rf'(?:^| ){_ANY["verb"]}(?: |$)')}",
        f"NOT ({_has('line', rf'^{_ANY["opener"]}\b')} AND NOT titled)",
        f"NOT {_has('line', rf'(?:^| )(?:{_ANY["dangling"]}|{_ANY["opener"]})$|[,(\[“\"/&-]$|^\p{{L}}{{1,2}}$|\([^)]*$')}",
        f"NOT {_has('core', rf'{_END}\n(?:[^ \n]+|{_ANY["article"]} [^\n]+)$')}",
        f"NOT {_has('line', _RUNS_ON)}",
    ]
)
_TITLED = f"NOT {_has(f"regexp_replace(line, '\\b{_q(_ANY['joining'])}\\b', '', 'g')", r'(?:^| )\p{Ll}')} OR {_has('line', r' \d{4}$')}"
_LAST = f"regexp_replace(line, '(?s)^.*{_q(_END)} +([\\p{{Lu}}“\"(])', '\\1')"
_ITEM = f"{_has('core', T._ITEM_END.replace(chr(92) + 'z', '$'))} AND {_has('core', r'\([a-z]{1,3}\) ')} AND {_has("regexp_extract(core, '(?s)^(.*)\\([a-z]{1,3}\\) ', 1)", r'^$|[.!?][”)]*[ \n]*$|\n$')}"
_ROW = f"contains(core, '|') AND {_BARS.format('line')} > 0 AND {_has('line', r'\|\s*[^|\s]')} AND NOT {_has('line', r'\|\s*$')} AND CASE WHEN NOT contains(core, chr(10)) OR {_BARS.format('above')} = 0 THEN {_BARS.format('line')} >= 3 ELSE {_BARS.format('line')} = {_BARS.format('above')} END"
_UNPIVOT = " UNION ALL ".join(f"SELECT s, text, ending, '{m}' AS measure, {m} AS length FROM t" for m in T.MEASURES)

JUDGED = rf"""
WITH src AS (SELECT doc_id, coalesce(lower(regexp_replace(source, '^[{_B}]+|[{_B}]+$', '', 'g')), '') AS s, text, {_has("right(text, 64)", _PLAIN)} AS plain FROM documents WHERE text IS NOT NULL),
ba AS (SELECT *, CASE WHEN plain THEN text ELSE regexp_replace(text, '{_MARKS}', '') END AS bare FROM src),
st AS (SELECT *, {_stem("bare")} AS stem FROM ba),
wh AS (SELECT *, plain OR ({_has("stem", f"{_END}$")} AND NOT {_has(f"right(stem, {T._NEAR})", f"{_ABBREVIATED}|{_DECIMAL}|{_MONEY}")}) AS whole FROM st),
co AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(bare, '[{_I}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+', '') AS core FROM wh),
li AS (SELECT *, string_split(core, chr(10))[-1] AS line, string_split(core, chr(10))[-2] AS above, {_stem("core")} AS cs FROM co),
ti AS (SELECT *, {_TITLED} AS titled, right(cs, {T._NEAR}) AS e FROM li),
en AS (SELECT *, CASE WHEN whole THEN 'whole' WHEN core = '' THEN 'blank' WHEN ({_ROW}) OR {_has("core", rf"{T.SIGNING}[^\n]+(?:\n[^\n]+){{1,3}}$")} THEN 'whole'
    WHEN {_has("cs", f"{_END}$")} THEN CASE WHEN {_has("e", _ABBREVIATED)} OR ({_has("e", _MONEY)} AND NOT {_has(_LAST, rf"(?:^| ){_ANY['verb']} ")}) THEN 'cut' WHEN {_has("e", _DECIMAL)} THEN 'either' ELSE 'whole' END
    WHEN {_has("string_split(line, ' ')[-1]", r"^(?:https?://|www\.).|^[^@]+@[^@]+$")} THEN 'whole'
    WHEN ({_ITEM}) OR {_has("core", "[:：—]$")} OR {_has("core", _BULLETS)} THEN 'either' WHEN {_HEADING} THEN 'either' WHEN {_has("core", r"[\p{Lo}\p{Mn}\p{Mc}]$")} THEN 'either' ELSE 'cut' END AS ending FROM ti),
t AS (SELECT DISTINCT s, text, ending, length(text) AS chars, strlen(text) AS bytes, length(bare) AS bare_chars, strlen(bare) AS bare_bytes FROM en),
by_measure AS ({_UNPIVOT}),
ed AS (SELECT s, measure, CAST(length AS BIGINT) AS length, count(*) AS ended, count(*) FILTER (WHERE ending <> 'whole') AS open, count(*) FILTER (WHERE ending = 'either') AS ei FROM by_measure GROUP BY ALL),
re AS (SELECT *, CAST(sum(ended) OVER (PARTITION BY s, measure ORDER BY length DESC) AS BIGINT) AS reached FROM ed),
ne AS (SELECT *, sum(ended) OVER w - ended AS near_ended, sum(ei) OVER w - ei AS near_ei, sum(reached) OVER w - reached AS near_reached, count(*) OVER w - 1 AS near FROM re
  WINDOW w AS (PARTITION BY s, measure ORDER BY length RANGE BETWEEN {T.NEIGHBOURS} PRECEDING AND {T.NEIGHBOURS} FOLLOWING)),
ex AS (SELECT *, reached * (near_ended + 1) / (near_reached + ({2 * T.NEIGHBOURS} - near) * reached) AS lam, reached * (near_ei + 1) / (near_reached + ({2 * T.NEIGHBOURS} - near) * reached) AS by_itself FROM ne),
lp AS (SELECT *, CASE WHEN ended > lam THEN -(ended * ln(ended / lam) - ended + lam) ELSE 0 END AS log_p FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY s, measure ORDER BY log_p, length) AS rank, count(*) OVER (PARTITION BY s, measure) AS tests FROM lp),
pa AS (SELECT *, max(CASE WHEN log_p <= ln({T.FDR} * rank / tests) THEN rank END) OVER (PARTITION BY s, measure) AS passed FROM rk),
bb AS (SELECT *, CASE WHEN length - lag(length) OVER (PARTITION BY s, measure ORDER BY length) <= {T.BAND} THEN 0 ELSE 1 END AS begins FROM pa WHERE rank <= passed),
bd AS (SELECT *, sum(begins) OVER (PARTITION BY s, measure ORDER BY length) AS band FROM bb),
fo AS (SELECT *, min(length) OVER b AS lo, max(length) OVER b AS hi, min(log_p) OVER b AS sharpest FROM bd WINDOW b AS (PARTITION BY s, measure, band)),
me AS (SELECT m.s, m.text, m.ending, m.length, replace(m.measure, 'bare_', '') AS unit, {{'p': sharpest, 'm': m.measure, 'lo': lo, 'hi': hi}} AS lim, by_itself <= {T.FDR} * open AS sure FROM by_measure m JOIN fo USING (s, measure, length)),
be AS (SELECT s, text, min(lim) AS best FROM me GROUP BY ALL),
sh AS (SELECT s, lim FROM (SELECT DISTINCT s, text, lim FROM me) JOIN be USING (s, text) GROUP BY ALL HAVING 2 * count(*) FILTER (WHERE lim = best) >= count(*)),
mt AS (SELECT me.s, text, ending, min(sh.lim) AS lim, bool_or(sure) AS sure FROM me JOIN sh ON sh.s = me.s AND replace(sh.lim.m, 'bare_', '') = unit AND length BETWEEN sh.lim.lo AND sh.lim.hi GROUP BY ALL),
op AS (SELECT en.doc_id, en.s, en.core, en.ending, coalesce(mt.s IS NOT NULL AND (en.ending = 'cut' OR mt.sure), false) AS limited FROM en LEFT JOIN mt ON mt.s = en.s AND mt.text = en.text WHERE en.ending IN ('cut', 'either')),
ju AS (SELECT doc_id, s, CASE WHEN limited THEN 'field limit' WHEN core IN (SELECT core FROM op WHERE limited) THEN 'copy' WHEN ending = 'cut' THEN 'transfer' END AS verdict FROM op)
"""

ORACLE = {
    "p8_found": f"{JUDGED} SELECT DISTINCT doc_id FROM ju WHERE verdict IS NOT NULL AND doc_id IS NOT NULL",
    "p8_report": f"""{JUDGED}, n AS (SELECT s, count(*) AS texts FROM src GROUP BY 1), k AS (SELECT s, count(*) FILTER (WHERE verdict = 'field limit') AS at_limit, count(*) FILTER (WHERE verdict IN ('copy', 'transfer')) AS in_transfer FROM ju GROUP BY 1)
SELECT s AS source_name, texts, coalesce(at_limit, 0) AS at_limit, coalesce(in_transfer, 0) AS in_transfer, round((coalesce(at_limit, 0) + coalesce(in_transfer, 0)) / texts, 6) AS share FROM n LEFT JOIN k USING (s)""",
    "p8_limits": f"{JUDGED} SELECT s AS source_name, lim.m AS measure, CAST(lim.lo AS INT) AS first, CAST(lim.hi AS INT) AS last, count(*) AS texts, count(*) FILTER (WHERE ending = 'cut' OR (ending = 'either' AND sure)) AS cut FROM mt GROUP BY ALL",
}
