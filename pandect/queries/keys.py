"""Names, citations, keys, titles, extents and sequences, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pandect.functions import citations as C
from pandect.functions import extents as X
from pandect.functions import titles as T
from pandect.functions.keys import law_key
from pandect.operators import register, sequences
from pandect.queries.sql import NA, NL, NU, key_sql
from pandect.sources.tables import table

UNIT = ["law_name", "law_id", "section_type", "sort_key", "position", "depth", "part", "chapter", "heading_group", "provision", "paragraph", "sub_paragraph", "schedule", "extent_code", "text"]


def _units(fn):
    return lambda spark, d: fn(register.units(table(spark, d, "lat"), *UNIT))


def _laws(fn):
    return lambda spark, d: fn(register.laws(table(spark, d, "uk_lrt"), "title_en", "type_code", "year", "number", "geo_extent", "md_date", "amending"))


def _notes(fn):
    return lambda spark, d: fn(register.annotations(table(spark, d, "amendment_annotations"), "law_name", "code", "code_type", "affected_sections", "created_at"))


def _levels():
    return {level: F.col(column) for level, column in C.LEVELS}


def _links(df):
    """Links as text units and feeds spell them, from each law's parts."""
    kinds = F.expr("year % 4")
    url = F.when(kinds == 0, F.concat_ws("/", F.lit("http://register.example/id"), "type_code", "year", "number")).when(kinds == 1, F.concat_ws("/", F.lit("https://register.example"), "type_code", "year", "number")).when(kinds == 2, F.concat_ws("/", F.lit("https://x.example/european/directive"), "year", "number")).otherwise(F.concat_ws("/", F.lit("https://x.example/european/regulation"), "year", "number"))
    return df.select("name", url.alias("url")).withColumn("target", C.law_of_url(F.col("url"), "register.example")).withColumn("enabling", C.is_enabling(F.col("target")))


QUERIES = {
    "law_ids": _laws(lambda x: x.select("name", C.uk_id(F.col("type_code"), F.col("year"), F.col("number")).alias("built"), C.slash_name(F.col("type_code"), F.col("year"), F.col("number")).alias("slash"), C.to_slash_form(F.col("name")).alias("slashed"), C.to_key_form(C.to_slash_form(F.col("name"))).alias("back"))),
    "reference_keys": _laws(lambda x: x.select("name", F.posexplode("amending").alias("n", "raw")).select("name", "n", law_key(F.col("raw")).alias("ref"))),
    "acronym_names": _laws(lambda x: x.select("name", C.without_acronym(F.concat(F.lit("UK_"), T.acronym(F.col("title_en")), F.lit("X_"), F.substring("name", 4, 100))).alias("before"), C.without_acronym(F.concat(F.col("name"), F.lit("_"), T.acronym(F.col("title_en")), F.lit("XY"))).alias("behind"))),
    "annotation_names": _notes(lambda a: a.select("id", C.law_of_annotation_id(F.concat_ws("_", "law_name", "code")).alias("law"), C.code_type(F.col("code")).alias("by_code"), C.annotation_id(F.col("law_name"), F.col("code_type"), F.lit(1)).alias("built"))),
    "law_links": _laws(_links),
    "page_paths": _laws(lambda x: x.select("name", C.path_parts(F.concat(F.lit("/"), F.concat_ws("/", "type_code", "year", "number"), F.lit("/enacted"))).alias("p")).select("name", "p.type_code", "p.year", "p.number")),
    "sort_keys": _units(lambda u: u.select("section_id", C.sort_key(F.col("provision")).alias("provision_key"), C.unit_sort_key(F.col("section_type"), F.col("provision"), F.col("heading_group"), F.col("sub_paragraph"), X.code_of_xml(F.col("extent_code"))).alias("unit_key"))),
    "hierarchy_paths": _units(lambda u: u.select("section_id", C.hierarchy_path(_levels()).alias("path"), C.depth(_levels()).cast("bigint").alias("levels"))),
    "citations": _units(lambda u: u.select("section_id", C.citation(F.col("section_type"), F.col("provision"), F.col("paragraph"), F.col("sub_paragraph"), F.lit(None).cast("string"), F.col("schedule"), F.col("heading_group"), F.col("part"), F.col("chapter"), F.col("position"), F.col("law_name").rlike("_(?:uksi|ssi|wsi)_")).alias("citation"))),
    "record_types": lambda spark, d: spark.createDataFrame([(k,) for k in [*C.RECORD_TYPES, " Section", "other", "amendment,textual", "part,content", *C.NOTE_HEADINGS]], "record_type string").select("record_type", C.section_type(F.col("record_type")).alias("section_type"), C.is_content(F.col("record_type")).alias("content")),
    "element_types": lambda spark, d: spark.createDataFrame([(k,) for k in [*C.ELEMENTS, "P1", "P2", "Body"]], "element string").select("element", C.element_type(F.col("element")).alias("in_act"), C.element_type(F.col("element"), "article").alias("in_instrument"), C.schedule_of_flow(F.lower("element")).alias("flow")),
    "code_counts_of_units": _notes(lambda a: a.groupBy("law_name").agg(*[F.sum(C.count_codes(F.array("code"), x)).cast("bigint").alias(f"n_{t}") for x, t in C.CODE_TYPES.items()])),
    "affected_lists": _notes(lambda a: a.select("id", F.array_join(C.listed(F.array_join("affected_sections", ", ")), "|").alias("refs"))),
    "title_classes": _laws(lambda x: x.select("name", T.type_class(F.col("title_en")).alias("type_class"), T.type_name(F.col("type_code")).alias("type_name"), T.acronym(F.col("title_en")).alias("acronym"))),
    "title_tags": _laws(lambda x: x.select("name", F.array_join(T.tags(F.col("title_en")), " ").alias("tags"))),
    "clean_titles": _laws(lambda x: x.select("name", T.clean_title(F.concat("title_en", F.lit(" (revoked)"))).alias("clean"), T.split_title(F.concat(F.lit("SI 1 - "), "title_en")).alias("rest"), C.slug(F.col("title_en")).alias("slug"))),
    "title_purposes": _laws(lambda x: x.select("name", T.title_purpose(F.col("title_en")).alias("purpose"), T.title_status(F.concat("title_en", F.lit(" (revoked)"))).alias("status"))),
    "dates_in_words": _laws(lambda x: x.where("md_date is not null").select("name", T.date_in_words(F.concat(F.lit("at 3.32 p.m. on "), F.date_format("md_date", "d"), F.lit("th "), F.date_format("md_date", "MMMM yyyy"))).alias("iso"))),
    "law_urls": _laws(lambda x: x.select("name", F.expr("try_cast(number as int)").alias("number_int"), F.concat(F.lit("https://register.example/"), "type_code", F.lit("/"), F.col("year").cast("string"), F.lit("/"), "number").alias("url"), F.year("md_date").alias("md_year"), F.month("md_date").alias("md_month"))),
    "extent_codes": _laws(lambda x: x.select("name", X.code_of_xml(F.col("geo_extent")).alias("code"), F.array_join(X.nations(X.compact(F.col("geo_extent"))), ",").alias("nations"), X.pan_region(X.nations(X.compact(F.col("geo_extent")))).alias("pan"), X.code_of_region(F.array_join(X.nations(X.compact(F.col("geo_extent"))), " and ")).alias("from_words"))),
    "geography": _units(lambda u: X.geography(u).select("law_name", F.array_join("extents", "|").alias("extents"), F.array_join("geo_region", "|").alias("regions"), "geo_pan_region")),
    "parallel_provisions": _units(lambda u: sequences.parallel(u, ["law_name", "provision"], "extent_code")),
    "unit_numbers": _units(lambda u: sequences.numbered(u, ["law_name"], ["sort_key", "section_id"], "n", F.substring("sort_key", 1, 3)).select("section_id", "n")),
    "annotation_numbers": _notes(lambda a: sequences.numbered(a, ["law_name", "code_type"], ["id"], "n").select("id", C.annotation_id(F.col("law_name"), F.col("code_type"), F.col("n")).alias("numbered"))),
    "unique_citations": _units(lambda u: sequences.disambiguated(u.withColumn("k", F.concat_ws(":", "law_name", "section_type", "provision")), "k", "position").select("section_id", "unique_key")),
    "sections_by_reference": _notes(lambda a: sequences.inverted(a, "id", "affected_sections", "created_at").select("ref", F.size("keys").cast("bigint").alias("n"))),
    "inherited_headings": _units(lambda u: sequences.inherited(u.withColumn("h", F.when(F.col("section_type") == "heading", F.col("text"))), ["law_name"], ["position", "section_id"], "h", "heading", F.floor(F.col("position") / 256)).select("section_id", "heading")),
    "merged_ranges": _units(lambda u: sequences.merged_ranges(u.where("position is not null").select("law_name", F.col("position").alias("a"), (F.col("position") + F.length("text") % 3).alias("b")), ["law_name"], "a", "b", 64)),
}

_NUM = r"^([0-9]*)(Z[A-Z]|[A-Z])?(Z[A-Z]|[A-Z])?"


def _sort_sql(c: str) -> str:
    t = f"upper(trim({c}))"

    def rank(i: int) -> str:
        s = f"regexp_extract({t}, '{_NUM}', {i})"
        return f"(CASE WHEN {s} = '' THEN 0 WHEN length({s}) = 2 THEN ascii({s}[2]) - 64 ELSE (ascii({s}) - 64) * 10 END)"

    n = f"coalesce(CAST(nullif(regexp_extract({t}, '{_NUM}', 1), '') AS BIGINT), 0)"
    return f"CASE WHEN coalesce({t}, '') = '' THEN '000.000.000' ELSE printf('%03d.%03d.%03d', {n}, {rank(2)}, {rank(3)}) END"


_ARTS = "('section', 'sub_section', 'article', 'sub_article')"
_BRACKETS = "coalesce('(' || paragraph || ')', '') || coalesce('(' || sub_paragraph || ')', '')"
_COMPACT = "nullif(regexp_replace(upper(geo_extent), '[. ()]', '', 'g'), '')"
_HAS = {c: f"list_contains(string_split({_COMPACT}, '+'), '{c}')" for c in ("E", "W", "S", "NI")}
_WHEN = {c: f"CASE WHEN {h} THEN '{n}' END" for (c, h), n in zip(_HAS.items(), ("England", "Wales", "Scotland", "Northern Ireland"), strict=True)}
_CODES = ", ".join(f"CASE WHEN {h} THEN '{c}' END" for c, h in _HAS.items())
_KNOWN = f"{_COMPACT} IS NOT NULL AND len(list_filter(string_split({_COMPACT}, '+'), lambda p: p NOT IN ('E', 'W', 'S', 'NI'))) = 0"

def _values(names) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ")"


def _case(x: str, table) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


_NOTE_LIST = ", ".join(f"'{n}'" for n in ("", *C.NOTE_HEADINGS))
_RANK = "CASE x WHEN 'E' THEN 1 WHEN 'W' THEN 2 WHEN 'S' THEN 3 WHEN 'NI' THEN 4 END"
ORACLE = {
    "record_types": f"SELECT k AS record_type, {_case('trim(k)', C.RECORD_TYPES)} AS section_type, NOT (trim(k) IN ({_NOTE_LIST}) OR trim(k) LIKE '%,content' OR regexp_matches(trim(k), '^(amendment|subordinate|editorial),')) AS content FROM {_values([*C.RECORD_TYPES, ' Section', 'other', 'amendment,textual', 'part,content', *C.NOTE_HEADINGS])} v(k)",
    "element_types": f"SELECT k AS element, {_case('k', {**C.ELEMENTS, **C.ELEMENTS_BY_KIND['section']})} AS in_act, {_case('k', {**C.ELEMENTS, **C.ELEMENTS_BY_KIND['article']})} AS in_instrument, CASE WHEN lower(k) NOT IN ('pre', 'main', 'post', 'signed', '') THEN lower(k) END AS flow FROM {_values([*C.ELEMENTS, 'P1', 'P2', 'Body'])} v(k)",
    "affected_lists": f"WITH {NA}, p AS (SELECT id, list_filter(list_transform(string_split(array_to_string(list_filter(affected_sections, lambda x: x IS NOT NULL), ', '), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM na) SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') END AS refs FROM p",
    "geography": f"""WITH {NU}, c AS (SELECT law_name, CASE regexp_replace(upper(extent_code), '[. ()]', '', 'g') WHEN 'EW' THEN 'E+W' WHEN 'EWS' THEN 'E+W+S' WHEN '' THEN NULL ELSE regexp_replace(upper(extent_code), '[. ()]', '', 'g') END AS e FROM nu),
d AS (SELECT DISTINCT law_name, e FROM c WHERE e IS NOT NULL AND law_name IS NOT NULL),
r AS (SELECT law_name, string_agg(CASE x WHEN 'E' THEN 'England' WHEN 'W' THEN 'Wales' WHEN 'S' THEN 'Scotland' WHEN 'NI' THEN 'Northern Ireland' END, '|' ORDER BY {_RANK}) AS regions, string_agg(x, '+' ORDER BY {_RANK}) AS pan FROM (SELECT DISTINCT law_name, unnest(string_split(e, '+')) AS x FROM d) GROUP BY 1)
SELECT law_name, string_agg(e, '|' ORDER BY strlen(e) DESC, e) AS extents, any_value(regions) AS regions, any_value(CASE pan WHEN 'E+W+S+NI' THEN 'UK' WHEN 'E+W+S' THEN 'GB' ELSE pan END) AS geo_pan_region FROM d JOIN r USING (law_name) GROUP BY law_name""",
    "law_ids": f"WITH {NL} SELECT name, 'UK_' || type_code || '_' || year || '_' || number AS built, concat_ws('/', type_code, year, number) AS slash, replace(replace(name, 'UK_', ''), '_', '/') AS slashed, name AS back FROM nl",
    "reference_keys": f"WITH {NL}, r AS (SELECT name, unnest(amending) AS raw, generate_subscripts(amending, 1) - 1 AS n FROM nl) SELECT name, CAST(n AS INT) AS n, {key_sql('raw')} AS ref FROM r",
    "acronym_names": f"WITH {NL} SELECT name, CASE WHEN title_en IS NOT NULL THEN name END AS before, CASE WHEN title_en IS NOT NULL THEN name END AS behind FROM nl",
    "annotation_names": f"WITH {NA} SELECT id, CASE WHEN regexp_matches(code, '^[FCIE][0-9]+$') THEN law_name END AS law, CASE left(code, 1) WHEN 'F' THEN 'amendment' WHEN 'C' THEN 'modification' WHEN 'I' THEN 'commencement' WHEN 'E' THEN 'extent_editorial' END AS by_code, concat_ws(':', law_name, code_type, '1') AS built FROM na",
    "law_links": f"""WITH {NL}, u AS (SELECT name, CASE year % 4 WHEN 0 THEN concat_ws('/', 'http://register.example/id', type_code, year, number) WHEN 1 THEN concat_ws('/', 'https://register.example', type_code, year, number)
      WHEN 2 THEN concat_ws('/', 'https://x.example/european/directive', year, number) ELSE concat_ws('/', 'https://x.example/european/regulation', year, number) END AS url,
      CASE WHEN year % 4 < 2 THEN concat_ws('/', type_code, year, number) WHEN year % 4 = 2 THEN concat_ws('/', 'eudr', year, number) ELSE concat_ws('/', 'eur', year, number) END AS target FROM nl)
      SELECT *, string_split(target, '/')[1] IN ('ukpga', 'anaw', 'asp', 'nia', 'apni', 'ukla', 'eur', 'eudr', 'eut') AS enabling FROM u""",
    "page_paths": f"WITH {NL} SELECT name, type_code, CAST(year AS VARCHAR) AS year, number FROM nl",
    "sort_keys": f"""WITH {NU} SELECT section_id, {_sort_sql('provision')} AS provision_key, CASE WHEN section_type IN {_ARTS} THEN {_sort_sql('provision')} WHEN section_type = 'heading' THEN {_sort_sql('heading_group')}
      WHEN section_type IN ('paragraph', 'sub_paragraph') THEN {_sort_sql('coalesce(sub_paragraph, provision)')} ELSE '000.000.000' END || '~' || coalesce(nullif(trim(replace(extent_code, 'N.I.', 'NI')), ''), '') AS unit_key FROM nu""",
    "hierarchy_paths": f"""WITH {NU}, p AS (SELECT section_id, ['schedule.' || nullif(schedule, ''), 'part.' || nullif(part, ''), 'chapter.' || nullif(chapter, ''), 'heading.' || nullif(heading_group, ''), 'provision.' || nullif(provision, ''), 'sub.' || nullif(paragraph, ''), 'para.' || nullif(sub_paragraph, '')] AS l FROM nu)
      SELECT section_id, nullif(array_to_string(list_filter(l, lambda x: x IS NOT NULL), '/'), '') AS path, len(list_filter(l, lambda x: x IS NOT NULL)) AS levels FROM p""",
    "citations": f"""WITH {NU}, c AS (SELECT *, CAST(coalesce(position, 0) AS VARCHAR) AS pl, coalesce('sch.' || schedule || '.', '') AS ins FROM nu)
      SELECT section_id, CASE WHEN section_type IN ('section', 'sub_section') THEN ins || 's.' || coalesce(provision, pl) || {_BRACKETS}
        WHEN section_type IN ('article', 'sub_article') THEN ins || CASE WHEN regexp_matches(law_name, '_(uksi|ssi|wsi)_') THEN 'reg.' ELSE 'art.' END || coalesce(provision, pl) || {_BRACKETS}
        WHEN section_type = 'schedule' THEN 'sch.' || coalesce(schedule, pl) WHEN section_type = 'part' THEN ins || 'pt.' || coalesce(part, pl) WHEN section_type = 'chapter' THEN ins || 'ch.' || coalesce(chapter, pl)
        WHEN section_type = 'heading' THEN ins || 'h.' || coalesce(heading_group, pl) WHEN section_type = 'paragraph' THEN ins || 'para.' || coalesce(sub_paragraph, provision, pl)
        WHEN section_type = 'sub_paragraph' THEN ins || 'para.' || coalesce(sub_paragraph, provision, pl) || '(' || pl || ')'
        WHEN section_type IN ('table', 'note') THEN ins || section_type || '.' || pl ELSE section_type || '.' || pl END AS citation FROM c""",
    "code_counts_of_units": f"WITH {NA} SELECT law_name, " + ", ".join(f"nullif(count(*) FILTER (WHERE code LIKE '{x}%'), 0) AS n_{t}" for x, t in C.CODE_TYPES.items()) + " FROM na GROUP BY 1",
    "title_classes": f"""WITH {NL}, t AS (SELECT name, type_code, title_en, regexp_extract(title_en, '(Act|Regulations?|Order|Rules?|Scheme|Measure)(\\s+\\d{{4}})?(\\s+\\(Northern Ireland\\))?[ ]?$', 1) AS w FROM nl)
      SELECT name, CASE WHEN w LIKE 'Regulation%' THEN 'Regulation' WHEN w LIKE 'Rule%' THEN 'Rules' ELSE nullif(w, '') END AS type_class,
      CASE type_code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TYPES.items())} END AS type_name, regexp_replace(regexp_replace(title_en, '^The ', ''), '[^A-Z]', '', 'g') AS acronym FROM t""",
    "title_tags": f"WITH {NL}, w AS (SELECT name, title_en, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title_en), '[^a-z\\s:]+', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ({', '.join(repr(s) for s in T.STOP_WORDS)})) AS l FROM nl) SELECT name, CASE WHEN title_en IS NOT NULL THEN array_to_string(list_transform(l, lambda x: upper(x[1]) || x[2:]), ' ') END AS tags FROM w",
    "clean_titles": f"WITH {NL} SELECT name, regexp_replace(regexp_replace(title_en, '^The ', ''), '[| ][0-9]{{4}}$', '') AS clean, title_en AS rest, regexp_replace(regexp_replace(lower(title_en), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM nl",
    "title_purposes": f"""WITH {NL} SELECT name, CASE WHEN title_en LIKE '%(Amendment%' THEN 'Amendment' WHEN title_en LIKE '%(Revocation)%' OR title_en LIKE '%(Repeal)%' THEN 'Repeal+Revocation' WHEN title_en LIKE '%(Commencement%' THEN 'Enactment+Citation+Commencement'
      WHEN title_en LIKE '%(Application)%' THEN 'Application+Scope' WHEN title_en LIKE '%(Transitional%' THEN 'Transitional Arrangement' WHEN title_en LIKE '%(Extent)%' OR title_en LIKE '%(Extension%' THEN 'Extent' END AS purpose,
      CASE WHEN title_en IS NOT NULL THEN '❌ Revoked / Repealed / Abolished' END AS status FROM nl""",
    "dates_in_words": f"WITH {NL} SELECT name, strftime(md_date, '%Y-%m-%d') AS iso FROM nl WHERE md_date IS NOT NULL",
    "law_urls": f"WITH {NL} SELECT name, TRY_CAST(number AS INT) AS number_int, 'https://register.example/' || type_code || '/' || year || '/' || number AS url, CAST(year(md_date) AS INT) AS md_year, CAST(month(md_date) AS INT) AS md_month FROM nl",
    "extent_codes": f"""WITH {NL}, e AS (SELECT name, nullif(trim(replace(geo_extent, 'N.I.', 'NI')), '') AS code, geo_extent, {_KNOWN} AS known, list_filter([{", ".join(_WHEN.values())}], lambda x: x IS NOT NULL) AS l, array_to_string(list_filter([{_CODES}], lambda x: x IS NOT NULL), '+') AS j FROM nl)
      SELECT name, code, CASE WHEN code IS NOT NULL THEN array_to_string(l, ',') END AS nations, CASE WHEN code IS NULL THEN NULL WHEN j = 'E+W+S+NI' THEN 'UK' WHEN j = 'E+W+S' THEN 'GB' ELSE j END AS pan, nullif(j, '') AS from_words FROM e""",
    "parallel_provisions": f"WITH {NU} SELECT law_name, provision, count(DISTINCT extent_code) AS extents FROM nu WHERE coalesce(extent_code, '') <> '' AND coalesce(provision, '') <> '' AND coalesce(law_name, '') <> '' GROUP BY 1, 2 HAVING count(DISTINCT extent_code) > 1",
    "unit_numbers": f"WITH {NU} SELECT section_id, CAST(row_number() OVER (PARTITION BY law_name ORDER BY sort_key NULLS FIRST, section_id) AS INT) AS n FROM nu",
    "annotation_numbers": f"WITH {NA} SELECT id, concat_ws(':', law_name, code_type, row_number() OVER (PARTITION BY law_name, code_type ORDER BY id)) AS numbered FROM na",
    "unique_citations": f"WITH {NU}, k AS (SELECT section_id, position, concat_ws(':', law_name, section_type, provision) AS k FROM nu) SELECT section_id, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN k || '#' || position ELSE k END AS unique_key FROM k",
    "sections_by_reference": f"WITH {NA}, r AS (SELECT id, unnest(affected_sections) AS ref FROM na) SELECT ref, count(DISTINCT id) AS n FROM r GROUP BY 1",
    "inherited_headings": f"WITH {NU} SELECT section_id, last_value(CASE WHEN section_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY law_name ORDER BY position NULLS FIRST, section_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM nu",
    "merged_ranges": f"""WITH {NU}, r AS (SELECT law_name, position AS a, position + length(text) % 3 AS b FROM nu WHERE position IS NOT NULL), f AS (SELECT *, CASE WHEN a > max(b) OVER w THEN 1 WHEN max(b) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY law_name ORDER BY a NULLS FIRST, b NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      i AS (SELECT *, sum(fresh) OVER (PARTITION BY law_name ORDER BY a NULLS FIRST, b NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT law_name, min(a) AS a, max(b) AS b FROM i GROUP BY law_name, island""",
}
