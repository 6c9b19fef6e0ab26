"""Classification of provisions, with SQL where its regular expressions can."""

from __future__ import annotations

from pyspark.sql import functions as F

from pandect.functions import taxa
from pandect.operators import register, roles
from pandect.queries.sql import B, NL, NU
from pandect.sources.tables import table

#: Actors of the register's holders and of its provisions.
NAMES = ["Gvt: Upland Board", "Gvt: Tally Office", "Gvt: Registrar", "Gvt: Inspectorate", "Gvt: Authority", "Gvt: Council", "Ind: Kiln Master", "Ind: Lessee", "Ind: Storekeeper", "Ind: Tenant", "Ind: Owner", "Org: Ferry Company", "Org: Mill Occupier", "Org: Quarry Agent", "Org: Depot Keeper", "Spc: Lamp Supplier", "Spc: Competent Person"]


def _units(fn):
    return lambda spark, d: fn(register.units(table(spark, d, "lat"), "law_name", "section_type", "provision", "text"))


def _laws(fn):
    return lambda spark, d: fn(register.laws(table(spark, d, "uk_lrt"), "title_en", "live_description", "amending", "amended_by"))


def _score(x):
    body, sched = F.size(F.coalesce("amending", F.array())) * 9, F.size(F.coalesce("amended_by", F.array())) * 20
    found = taxa.signals(F.col("title_en"), F.concat(F.lit("An Act to require and to amend the "), "live_description"), body, sched)
    return x.select("name", F.size(found).cast("bigint").alias("n_signals"), taxa.making_score(found).alias("score")).withColumn("class", taxa.making_class(F.col("score")))


def _rules(u):
    lib = roles.library_from_names(NAMES)
    found = u.select("law_name", F.concat_ws("-", "section_type", "provision").alias("article"), roles.clauses(F.col("text"), lib).alias("rules"))
    return roles.merged_by_law(found)


QUERIES = {
    "clean_texts": _units(lambda u: u.select("section_id", taxa.clean(F.col("text")).alias("clean"))),
    "purpose_classify": _units(lambda u: u.select("section_id", F.array_join(taxa.purposes(F.col("text")), "|").alias("purposes"))),
    "category_classify": _units(lambda u: u.select("section_id", F.array_join(taxa.categories(F.col("text"), F.array(F.lit("Duty"))), "|").alias("categories"))),
    "purpose_counts": _units(lambda u: register.counts_by(u.select(F.explode(taxa.purposes(F.col("text"))).alias("purpose")), "purpose")),
    "making_score": _laws(_score),
    "clause_confidence": _units(lambda u: u.select("section_id", taxa.clause_confidence(F.col("text"), F.col("provision").isNotNull()).alias("confidence")).withColumn("with_article", taxa.with_article_bonus(F.col("confidence")))),
    "actor_extract": _units(lambda u: roles.with_actors(u.select("section_id", "text"), "text", roles.library_from_names(NAMES)).select("section_id", F.array_join("role", "|").alias("role"), F.array_join("role_gvt", "|").alias("role_gvt"))),
    "duty_extract": _units(lambda u: u.select("section_id", F.explode(roles.clauses(F.col("text"), roles.library_from_names(NAMES))).alias("r")).select("section_id", "r.*").withColumn("confidence", taxa.clause_confidence(F.col("clause"), F.col("captured")))),
    "duty_extract_first": _units(lambda u: u.select("section_id", F.explode(roles.clauses(F.col("text"), roles.library_from_names(NAMES), version=1)).alias("r")).select("section_id", "r.holder", "r.duty_type", "r.clause")),
    "rules_by_law": _units(lambda u: _rules(u).select("law_name", F.size("entries").cast("bigint").alias("n_entries"), F.array_join("holders", "|").alias("holders"), F.array_join("duty_types", "|").alias("duty_types"), taxa.is_making(F.transform("duty_types", F.initcap)).alias("is_making"))),
}


def _q(p: str) -> str:
    return p.replace("'", "''")


def _shown(vocabulary) -> str:
    cells = ", ".join(f"CASE WHEN regexp_matches(text, '{_q(taxa.pattern_of(terms))}') THEN '{_q(n)}' END" for n, terms in vocabulary.items())
    return f"list_filter([{cells}], lambda x: x IS NOT NULL)"


def _signal_sql() -> str:
    ex = " OR ".join(f"contains(title_en, '{x}')" for *_, x in taxa.TITLE_SIGNALS[:5])
    rows = [(1, False, "1.0", "contains(title_en, '(Appointed Day')"), (1, False, "0.99", "NOT contains(title_en, '(Appointed Day') AND contains(title_en, '(Commencement')")]
    rows += [(t, m, c, f"contains(title_en, '{x}')") for t, _, m, c, x in taxa.TITLE_SIGNALS]
    rows += [(t, True, c, f"NOT ({ex}) AND contains(title_en, '{x}')") for t, _, c, x in taxa.POSITIVE_TITLE_SIGNALS]
    rows += [(3, False, "0.9", "body <= 3 AND sched > 50"), (3, True, "round(least(0.85::DOUBLE, 0.5::DOUBLE + body / 500.0::DOUBLE), 2)", "body > 50"), (3, True, "0.4", "body BETWEEN 11 AND 50"), (3, False, "0.6", "body <= 5")]
    rows += [(4, m, c, f"contains(lower(descr), '{x}')") for _, m, c, x in taxa.DESCRIPTION_SIGNALS]
    cells = ", ".join(f"CASE WHEN {w} THEN {{'m': {str(m).lower()}, 't': {t}, 'w': CAST({c} AS DOUBLE) * CAST({taxa.TIER_WEIGHTS[t]} AS DOUBLE)}} END" for t, m, c, w in rows)
    return f"""WITH {NL}, d AS (SELECT name, title_en, 'An Act to require and to amend the ' || live_description AS descr, coalesce(len(amending), 0) * 9 AS body, coalesce(len(amended_by), 0) * 20 AS sched FROM nl),
s AS (SELECT name, list_sort(list_filter([{cells}], lambda x: x IS NOT NULL)) AS l FROM d),
r AS (SELECT name, len(l) AS n_signals, round(list_reduce(list_concat([CAST({taxa.PRIOR} AS DOUBLE)], list_transform(l, lambda x: CASE WHEN x.m THEN 2 + x.w ELSE x.w END)), lambda a, x: CASE WHEN x >= 2 THEN a + (1 - a) * (x - 2) ELSE a * (1 - x) END), 4) AS score FROM s)
SELECT *, CASE WHEN score >= 0.70 THEN 'making' WHEN score <= 0.30 THEN 'not_making' ELSE 'uncertain' END AS class FROM r"""


def _actors_sql(names: str) -> str:
    """Each pattern of the library in turn, taken out of the text where it matches first."""
    edge = rf"[{B}\p{{P}}\p{{S}}]"
    steps, last, hits = [], "s0", []
    for i, (name, pattern) in enumerate(roles.library_from_names(NAMES)):
        if roles.governs(name) != (names == "role_gvt"):
            continue
        p = _q(f"{edge}(?:{pattern})".replace("\\ ", " ") + edge)
        steps.append(f"s{i + 1} AS (SELECT * REPLACE (regexp_replace(t, '{p}', '') AS t, CASE WHEN regexp_matches(t, '{p}') THEN list_append(l, '{_q(name)}') ELSE l END AS l) FROM {last})")
        last = f"s{i + 1}"
    return f"(WITH s0 AS (SELECT section_id, ' ' || text || ' ' AS t, CAST([] AS VARCHAR[]) AS l FROM nu), {', '.join(steps)} SELECT section_id, array_to_string(list_sort(l), '|') AS {names} FROM {last})"


def _rules_sql() -> str:
    """Rules by place: every place of an actor, the first modal behind it, and the line around that."""
    edge = rf"[{B}\p{{P}}\p{{S}}]"
    parts = []
    for i, (name, pattern) in enumerate(roles.library_from_names(NAMES)):
        p = _q(pattern)
        for kind, (government, modal) in roles.KINDS.items():
            if government != roles.governs(name):
                continue
            word = modal.partition("(?!")[0]
            lead = rf"(?s)^([^—.]{{0,{roles.BEFORE}}}?)\b({word})[,{B}—]+"
            parts.append(f"""SELECT *, pos + size + length(pre) AS m0, pos + size + length(pre) + length(md) AS m1, pos + size + length(whole) AS s1 FROM (
  SELECT section_id, text, {i} AS rank, '{_q(name)}' AS holder, '{kind}' AS duty_type, pos, size, regexp_extract(rest, '{lead}', 1) AS pre, regexp_extract(rest, '{lead}', 2) AS md, regexp_extract(rest, '{lead}') AS whole FROM (
    SELECT section_id, text, pos, size, substring(masked, pos + size + 1) AS rest FROM (
      SELECT section_id, text, masked, CAST(list_sum(list_transform(ps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS pos, length(hs[j]) AS size FROM (
        SELECT *, unnest(range(1, len(hs) + 1)) AS j FROM (SELECT section_id, text, masked, string_split_regex(text, '{p}') AS ps, regexp_extract_all(text, '{p}') AS hs FROM mk)))
    WHERE (pos = 0 OR regexp_matches(substring(text, pos, 1), '{edge}')) AND regexp_matches(substring(text, pos + size + 1, 1), '{edge}'))) WHERE md <> ''""")
    return rf"""mk AS (SELECT section_id, text, regexp_replace(regexp_replace(text, '\b(shal|mus)[lt]([{B}]+have the power)', '\1' || chr(1) || '\2', 'g'), '\bmay([{B}]+(?:not|be))', 'ma' || chr(1) || '\1', 'g') AS masked FROM nu WHERE regexp_matches(text, '(?i)\b(?:shall|must|may)\b')),
hit AS ({" UNION ALL ".join(parts)}),
cl AS (SELECT *, s1 < length(text) AS captured, substring(text, greatest(0, greatest(pos - 1, 0) - 100) + 1, m0 - greatest(0, greatest(pos - 1, 0) - 100)) AS head, substring(text, m1 + 1, least(length(text), s1 + {roles.BEHIND}) - m1) AS tail FROM hit),
ln AS (SELECT *, trim(regexp_replace(regexp_replace(head, '(?s)^.*[.;][{B}]+(\p{{Lu}}.*)$', '\1') || md || CASE WHEN regexp_matches(tail, '(?s)[.;](?:[{B}]|$)') THEN regexp_extract(tail, '(?s)^(.*?[.;])(?:[{B}]|$)', 1) ELSE tail END, '[{B}]+', ' ', 'g')) AS line FROM cl),
ru AS (SELECT section_id, holder, duty_type, captured, rank, pos, CASE WHEN regexp_matches(line, '[.;!?)]$') THEN line ELSE rtrim(line, ' ,') || '...' END AS clause FROM ln),
rules AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY section_id, duty_type, lower(clause) ORDER BY length(holder) DESC, rank, pos) = 1)"""


ORACLE = {
    "duty_extract": rf"WITH {NU}, {_rules_sql()} SELECT section_id, holder, duty_type, clause, captured, round(CASE WHEN captured THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN NOT ends_with(clause, '...') THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(clause) > 30 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(clause, '(?i)\b(?:shall|must)\b') THEN 0.15::DOUBLE ELSE 0 END, 2) AS confidence FROM rules",
    "rules_by_law": f"WITH {NU}, {_rules_sql()}, j AS (SELECT DISTINCT law_name, concat_ws('-', section_type, provision) AS article, holder, duty_type, clause, captured FROM rules JOIN nu USING (section_id)) SELECT law_name, count(*) AS n_entries, string_agg(DISTINCT holder, '|' ORDER BY holder) AS holders, string_agg(DISTINCT duty_type, '|' ORDER BY duty_type) AS duty_types, bool_or(duty_type IN ('DUTY', 'RESPONSIBILITY')) AS is_making FROM j GROUP BY 1",
    "actor_extract": f"WITH {NU} SELECT * FROM {_actors_sql('role')} JOIN {_actors_sql('role_gvt')} USING (section_id)",
    "clean_texts": f"WITH {NU} SELECT section_id, regexp_replace(text, '{_q(taxa.pattern_of(taxa.NOISE))}', ' ', 'g') AS clean FROM nu",
    "purpose_classify": f"WITH {NU}, p AS (SELECT section_id, text, {_shown(taxa.PURPOSES)} AS l FROM nu) SELECT section_id, CASE WHEN coalesce(text, '') = '' THEN '' WHEN len(l) = 0 THEN '{taxa.DEFAULT_PURPOSE}' ELSE array_to_string(l, '|') END AS purposes FROM p",
    "purpose_counts": f"WITH {NU}, p AS (SELECT {_shown(taxa.PURPOSES)} AS l FROM nu WHERE coalesce(text, '') <> '') SELECT purpose, count(*) AS n FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN ['{taxa.DEFAULT_PURPOSE}'] ELSE l END) AS purpose FROM p) GROUP BY 1",
    "category_classify": f"WITH {NU}, p AS (SELECT section_id, text, {_shown(taxa.CATEGORIES)} AS l FROM nu) SELECT section_id, CASE WHEN coalesce(text, '') = '' THEN '' WHEN len(l) = 0 THEN '{taxa.FALLBACK_CATEGORY}' ELSE array_to_string(l, '|') END AS categories FROM p",
    "making_score": _signal_sql(),
    "clause_confidence": f"""WITH {NU}, c AS (SELECT section_id, CASE WHEN coalesce(text, '') = '' THEN 0.0::DOUBLE ELSE round(CASE WHEN provision IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN NOT ends_with(text, '...') THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(text) > 30 THEN 0.2::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(text, '(?i)\\b(?:shall|must)\\b') THEN 0.15::DOUBLE ELSE 0 END, 2) END AS confidence FROM nu) SELECT *, least(confidence + 0.15::DOUBLE, 1.0::DOUBLE) AS with_article FROM c""",
}
