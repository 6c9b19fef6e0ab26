"""Sources and sinks, by round trips over the tables, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pandect.operators import law_documents, register, worklists
from pandect.plans.cut import shared_folder
from pandect.queries.problems import _DOCS
from pandect.queries.sql import NL, NU
from pandect.sources import files, markup
from pandect.sources.tables import table


def _place(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _escaped(c):
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _pages(spark, d):
    """A page of XML per unit of a provision, with its number, text and extent."""
    u = register.units(table(spark, d, "lat"), "provision", "extent_code", "section_type", "text").where("section_type in ('section', 'article') and text <> ''")
    xml = F.concat(F.lit('<Legislation xmlns="urn:l"><Body><P1 id="x" RestrictExtent="'), F.coalesce("extent_code", F.lit("")), F.lit('"><Pnumber>'), F.coalesce("provision", F.lit("")), F.lit("</Pnumber><P1para><Text>"), _escaped(F.regexp_replace("text", r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]", "")), F.lit("</Text></P1para></P1></Body></Legislation>"))
    return u.select("section_id", xml.alias("xml"))


def _tables(spark, d):
    """A page of HTML per change, in the columns of a table of changes."""
    c = law_documents.detail_table(law_documents.law_nodes(table(spark, d, "uk_lrt")))
    link = F.concat(F.lit("/id/"), F.translate(F.substring("item", 4, 100), "_", "/"))
    cell = lambda x: F.concat(F.lit("<td>"), _escaped(x), F.lit("</td>"))
    html = F.concat(F.lit('<table><tbody><tr><td><a href="'), link, F.lit('">t</a></td><td></td>'), cell(F.col("target")), cell(F.col("affect")), F.lit("<td></td><td></td><td></td>"), cell(F.col("applied")), F.lit("<td></td></tr></tbody></table>"))
    return c.select("law_name", "item", "detail_no", html.alias("html"))


def _csv(spark, d):
    """Families and years of some laws exported, and written over the register."""
    laws = register.laws(table(spark, d, "uk_lrt"), "family", "year").select("name", "family", "year")
    place = _place(spark)
    export = laws.where("year >= 2010").select("name", F.upper("family").alias("Family"), (F.col("year") + 1).cast("string").alias("Year"))
    export.write.option("header", True).option("escape", '"').csv(place)
    return files.update_from_csv(laws, files.read_csv(spark, place, {"name": "name", "Family": "family", "Year": "year"}))


def _metrics(spark, d):
    """Events as a log of metrics, read back within a range of time."""
    place = _place(spark)
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("event"), F.create_map(F.lit("duration_us"), F.col("event_id")).alias("measurements"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"))
    files.append_metrics(e, place)
    got = files.read_metrics(spark, place, after="2024-01-05T00:00:00", before="2024-01-20T00:00:00")
    return got.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("measurements")["duration_us"]).alias("total"))


def _delimited(spark, d):
    place = _place(spark)
    names = files.write_delimited(register.laws(table(spark, d, "uk_lrt"), "type_code", "year", "number"), place, ["name", "type_code", "year", "absent"])
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "\\N").csv(place).select(*names)


def _arrow(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return files.from_arrow_bytes(spark, files.arrow_bytes(n, ["n_nationkey"]))


def _law_pages(spark, d):
    """Per law a page of XML with its introduction, a note and a clause."""
    x = register.laws(table(spark, d, "uk_lrt"), "title_en", "year", "number", "live", "geo_extent")
    gone = F.when(F.col("live").contains("Revoked"), " (revoked)").otherwise("")
    cite = F.concat(F.lit('<Citation id="c00001" URI="http://register.example/id/ukpga/'), F.col("year").cast("string"), F.lit("/"), F.coalesce("number", F.lit("0")), F.lit('">Act</Citation>'))
    xml = F.concat(
        F.lit('<l:Legislation xmlns:l="urn:l" xmlns:dc="urn:dc"><l:Metadata><dc:title>'), _escaped(F.col("title_en")), gone, F.lit("</dc:title><dc:description>About  it</dc:description><dc:subject>A</dc:subject><dc:subject> B </dc:subject>"),
        F.lit('<l:BodyParagraphs Value="'), (F.length("name") % 7).cast("string"), F.lit('"/></l:Metadata><l:IntroductoryText><l:P>In exercise of powers</l:P></l:IntroductoryText><l:EnactingText>under '), F.lit('<l:FootnoteRef Ref="f00001"/>'), F.regexp_replace(cite, "(</?)Citation", "$1l:Citation"), F.lit('</l:EnactingText><l:Body><l:P1><l:P>First.</l:P></l:P1><l:P1 id="s2"><l:P> </l:P></l:P1></l:Body><l:Footnote id="f00001">'), F.regexp_replace(F.replace(cite, F.lit(' id="c00001"'), F.lit("")), "(</?)Citation", "$1l:Citation"),
        F.lit('</l:Footnote><l:Commentaries><l:Commentary id="k1" Type="F"><l:Para>Revoked by </l:Para>'), F.regexp_replace(F.replace(cite, F.lit(' id="c00001"'), F.lit("")), "(</?)Citation", "$1l:Citation"), F.lit('</l:Commentary><l:Commentary id="k2" Type="X"/><l:Commentary id="k3" Type="C">Applied</l:Commentary></l:Commentaries></l:Legislation>'),
    )
    return x.select("name", xml.alias("xml"))


def _listings(spark, d):
    """Per law a page that lists it and one more, and for some a table."""
    x = register.laws(table(spark, d, "uk_lrt"), "title_en", "year")
    html = F.concat(F.lit('<div><h6><a href="/id/first">First</a></h6><p>One  line</p><h6><a href="/id/'), F.translate("name", "_", "/"), F.lit('">'), _escaped(F.col("title_en")), F.lit("</a></h6><p></p></div>"), F.when(F.col("year") % 2 == 0, "<table><tbody><tr></tr></tbody></table>").otherwise(""))
    return x.select("name", html.alias("html"))


def _law_xml(rows, schema):
    return lambda spark, d: markup.shred(_law_pages(spark, d), ["name"], "xml", rows, schema)


def _reshredded(spark, d):
    """Units of one law made anew from its pages and put in place of the old ones."""
    units = register.units(table(spark, d, "lat"), "section_type", "provision", "text").select("section_id", "law_name", "section_type", "provision", "text")
    pages = _pages(spark, d).join(units.where(F.col("law_name") == RESHREDDED).select("section_id"), "section_id", "left_semi")
    made = markup.shred(pages, ["section_id"], "xml", markup.unit_rows, markup.UNIT_ROW)
    made = made.select("section_id", F.lit(RESHREDDED).alias("law_name"), "section_type", "provision", "text")
    after = worklists.replaced(units, made, "law_name", RESHREDDED)
    return after.where("law_name is not null").groupBy("law_name").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("section_type") == "section").alias("sections"))


#: The law that is shredded again; it holds about a tenth of the units.
RESHREDDED = "UK_ukpga_1987_5001"

QUERIES = {
    "reshred_law": _reshredded,
    "html_listing": lambda spark, d: markup.shred(_listings(spark, d), ["name"], "html", markup.listing_rows, markup.LISTING_ROW),
    "html_with_table": lambda spark, d: _listings(spark, d).where(markup.has_table(F.col("html"))).select("name"),
    "xml_metadata": lambda spark, d: _law_xml(markup.metadata_row, markup.METADATA_ROW)(spark, d).select("name", "title", "description", F.array_join("subjects", "|").alias("subjects"), "body_paras"),
    "xml_commentaries": _law_xml(markup.commentary_rows, markup.COMMENTARY_ROW),
    "xml_enacting": lambda spark, d: _law_xml(markup.enacting_row, markup.ENACTING_ROW)(spark, d).select("name", "text", F.array_join(F.col("urls")["f00001"], "|").alias("footnote"), F.array_join(F.col("urls")["c00001"], "|").alias("citation")),
    "xml_repeal": lambda spark, d: _law_xml(markup.repeal_row, markup.REPEAL_ROW)(spark, d).select("name", "title", "revoked", F.array_join("revoking", "|").alias("revoking")),
    "xml_provisions": _law_xml(markup.section_rows, markup.SECTION_ROW),
    "xml_text": lambda spark, d: _law_xml(markup.document_text, markup.TEXT_ROW)(spark, d).select("name", F.length("text").alias("size"), F.contains("text", F.lit("In exercise of powers under")).alias("clause")),
    "xml_units": lambda spark, d: markup.shred(_pages(spark, d), ["section_id"], "xml", markup.unit_rows, markup.UNIT_ROW).select("section_id", "section_type", "provision", "extent_code", "text", "position"),
    "xml_sections": lambda spark, d: markup.shred(_pages(spark, d), ["section_id"], "xml", markup.section_rows, markup.SECTION_ROW).select("section_id", "section_ref"),
    "html_changes": lambda spark, d: markup.shred(_tables(spark, d).where(markup.has_table(F.col("html"))), ["law_name", "item", "detail_no"], "html", markup.change_rows, markup.CHANGE_ROW).select("law_name", "item", "detail_no", "name", "target", "affect", "applied"),
    "csv_update": _csv,
    "metric_log": _metrics,
    "delimited_export": _delimited,
    "arrow_round_trip": _arrow,
}

_WORDS = r"trim(regexp_replace(text, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{1680}\x{85}\x{2028}\x{2029}]+', ' ', 'g'))"
_L = f"WITH {NL}, x AS (SELECT name, CASE WHEN title_en IS NULL THEN '' ELSE trim(regexp_replace(title_en, '\\s+', ' ', 'g')) END AS t, coalesce(contains(live, 'Revoked'), false) AS gone, year, 'http://register.example/id/ukpga/' || year || '/' || coalesce(number, '0') AS u FROM nl WHERE year IS NOT NULL)"
ORACLE = {
    "reshred_law": f"WITH {NU}, a AS (SELECT law_name, CASE WHEN law_name = '{RESHREDDED}' THEN 'section' ELSE section_type END AS section_type FROM nu WHERE law_name <> '{RESHREDDED}' OR (section_type IN ('section', 'article') AND text <> '')) SELECT law_name, count(*) AS units, count(*) FILTER (WHERE section_type = 'section') AS sections FROM a WHERE law_name IS NOT NULL GROUP BY 1",
    "html_listing": f"{_L} SELECT name, '/id/' || replace(name, '_', '/') AS path, nullif(t, '') AS title_en, NULL AS description FROM x UNION ALL SELECT name, '/id/first', 'First', 'One line' FROM x",
    "html_with_table": f"{_L} SELECT name FROM x WHERE year % 2 = 0",
    "xml_metadata": f"{_L} SELECT name, nullif(trim(t || CASE WHEN gone THEN ' (revoked)' ELSE '' END), '') AS title, 'About it' AS description, 'A|B' AS subjects, CAST(length(name) % 7 AS INT) AS body_paras FROM x",
    "xml_commentaries": f"{_L} SELECT name, 'k1' AS ref, 'F1' AS code, 'amendment' AS code_type, 'Revoked by Act' AS text, CAST(1 AS INT) AS ordinal FROM x UNION ALL SELECT name, 'k3', 'C2', 'modification', 'Applied', 2 FROM x",
    "xml_enacting": f"{_L} SELECT name, 'In exercise of powers under Act' AS text, u AS footnote, u AS citation FROM x",
    "xml_repeal": f"{_L} SELECT name, nullif(trim(t || CASE WHEN gone THEN ' (revoked)' ELSE '' END), '') AS title, gone AS revoked, u AS revoking FROM x",
    "xml_text": f"{_L} SELECT name, CAST(length(trim(t || CASE WHEN gone THEN ' (revoked)' ELSE '' END || ' About it A B In exercise of powers under Act First. Act Revoked by Act Applied')) AS INT) AS size, true AS clause FROM x",
    "xml_provisions": f"{_L} SELECT name, 'section-1' AS section_ref, 'First.' AS text FROM x",
    "xml_units": f"WITH {NU} SELECT section_id, 'section' AS section_type, nullif(regexp_replace(provision, '[.()\\s]+', '', 'g'), '') AS provision, nullif(replace(extent_code, 'N.I.', 'NI'), '') AS extent_code, nullif({_WORDS}, '') AS text, CAST(1 AS INT) AS position FROM nu WHERE section_type IN ('section', 'article') AND text <> ''",
    "xml_sections": f"WITH {NU} SELECT section_id, 'x' AS section_ref FROM nu WHERE section_type IN ('section', 'article') AND text <> '' AND (trim({_WORDS}) <> '' OR coalesce(provision, '') <> '')",
    "html_changes": f"{_DOCS} SELECT law_name, item, CAST(detail_no AS INT) AS detail_no, item AS name, coalesce(x.target, '') AS target, coalesce(x.affect, '') AS affect, coalesce(x.applied, '') AS applied FROM detail WHERE x IS NOT NULL",
    "csv_update": f"WITH {NL} SELECT name, CASE WHEN year >= 2010 THEN upper(family) ELSE family END AS family, CASE WHEN year >= 2010 THEN year + 1 ELSE year END AS year FROM nl",
    "metric_log": "SELECT event_type AS event, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-05T00:00:00' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') < '2024-01-20T00:00:00' GROUP BY 1",
    "delimited_export": f"WITH {NL} SELECT name, type_code, CAST(year AS VARCHAR) AS year FROM nl",
    "arrow_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
}
