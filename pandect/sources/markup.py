"""Landed XML and HTML pages to rows.

Pages are landed as Parquet (``url, html`` or ``name, xml``); fetching is not
done here. Parsers run as Arrow-batched generators, because XML functions of
SQL fail a whole job on one malformed page, and recursion with inherited
context has no SQL form. Malformed pages give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pandect.functions.citations import ELEMENTS, ELEMENTS_BY_KIND

_SPACES = re.compile(r"\s+")


def text_of(node: ET.Element | None, skip: tuple[str, ...] = ()) -> str | None:
    """All text below an element, blanks collapsed; elements in ``skip`` are left out."""
    if node is None:
        return None
    out = [node.text or ""]
    stack = [(node, iter(node))]  # of its own, so depth has no limit
    while stack:
        child = next(stack[-1][1], None)
        if child is None:
            done, _ = stack.pop()
            if stack:
                out.append(done.tail or "")
        elif child.tag in skip:
            out.append(child.tail or "")
        else:
            out.append(child.text or "")
            stack.append((child, iter(child)))
    return _SPACES.sub(" ", " ".join(out)).strip() or None


def parse(xml: str | None) -> ET.Element | None:
    """Root element with namespaces removed, or None if the text isn't XML."""
    if not xml:
        return None
    try:
        root = ET.fromstring(xml.lstrip("﻿"))
    except ET.ParseError:
        return None
    for n in root.iter():
        n.tag = n.tag.rpartition("}")[2] if isinstance(n.tag, str) else ""
        n.attrib = {k.rpartition("}")[2]: v for k, v in n.attrib.items()}
    return root


def number_of(node: ET.Element, tag: str) -> str | None:
    """The number in an element's heading, without its word and marks."""
    found = text_of(node.find(tag))
    return re.sub(r"^(?:PART|Part|CHAPTER|Chapter|SCHEDULE|Schedule)\s+|[.()\s]+", "", found) or None if found else None


#: Levels that an element sets, and those below it that it clears.
_SETS = {"Schedule": ("schedule", ("part", "chapter", "heading_group", "provision", "paragraph", "sub_paragraph")), "Part": ("part", ("chapter", "heading_group", "provision", "paragraph", "sub_paragraph")), "Chapter": ("chapter", ("heading_group", "provision", "paragraph", "sub_paragraph")), "Pblock": ("heading_group", ("provision", "paragraph", "sub_paragraph")), "P1": ("provision", ("paragraph", "sub_paragraph")), "P2": ("paragraph", ("sub_paragraph",)), "P3": ("sub_paragraph", ()), "P4": (None, ())}
_NUMBER_TAG = {"P1": "Pnumber", "P2": "Pnumber", "P3": "Pnumber", "P4": "Pnumber"}
UNIT_ROW = "section_type string, part string, chapter string, heading_group string, provision string, paragraph string, sub_paragraph string, schedule string, extent_code string, text string, refs array<string>, position int"
LEVELS = ("part", "chapter", "heading_group", "provision", "paragraph", "sub_paragraph", "schedule")


def unit_rows(xml: str | None, kind: str = "section") -> list[dict]:
    """Rows of a law's body in document order. A level that opens clears those
    below it; extents are inherited; a heading is known by its first provision."""
    root = parse(xml)
    if root is None:
        return []
    types = {**ELEMENTS, **ELEMENTS_BY_KIND[kind]}
    rows: list[dict] = []

    stack: list[tuple[ET.Element, dict, str | None]] = [(root, dict.fromkeys(LEVELS), None)]
    while stack:
        node, levels, extent = stack.pop()
        extent = (node.get("RestrictExtent") or extent or "").replace("N.I.", "NI") or None
        if node.tag in types:
            level, below = _SETS.get(node.tag, (None, ()))
            levels = {**levels, **dict.fromkeys(below)}
            if node.tag == "Pblock":
                first = next(iter(node.iter("P1")), None)
                levels["heading_group"] = number_of(first, "Pnumber") if first is not None else None
            elif level:
                levels[level] = number_of(node, _NUMBER_TAG.get(node.tag, "Number"))
            inner = ("P1", "P2", "P3", "P4", "P1group", "Pblock", "Part", "Chapter", "Number", "Pnumber")
            title = text_of(node.find("Title")) if node.tag in ("Part", "Chapter", "Pblock", "Schedule") else text_of(node, inner)
            refs = [r.get("Ref") for r in node.iter("CommentaryRef") if r.get("Ref")]
            rows.append({"section_type": types[node.tag], **{k: levels.get(k) for k in LEVELS}, "extent_code": extent, "text": title, "refs": refs, "position": len(rows) + 1})
        stack.extend((child, levels, extent) for child in reversed(node))
    return rows


COMMENTARY_ROW = "ref string, code string, code_type string, text string, ordinal int"


def commentary_rows(xml: str | None) -> list[dict]:
    """Annotations of a law, in document order."""
    root = parse(xml)
    kinds = {"F": "amendment", "C": "modification", "I": "commencement", "E": "extent_editorial"}
    out = []
    for n in root.iter("Commentary") if root is not None else ():
        kind = (n.get("Type") or "")[:1]
        if kind in kinds:
            out.append({"ref": n.get("id"), "code": f"{kind}{len(out) + 1}", "code_type": kinds[kind], "text": text_of(n), "ordinal": len(out) + 1})
    return out


EXTENT_ROW = "provision string, extent string"


def extent_rows(xml: str | None) -> list[dict]:
    """(provision, extent) of a table of contents; items without extent are left out."""
    root = parse(xml)
    pairs = [(n.get("ContentRef"), (n.get("RestrictExtent") or "").replace(".", "")) for n in (root.iter("ContentsItem") if root is not None else ())]
    return [{"provision": p, "extent": e} for p, e in pairs if e]


METADATA_ROW = "title string, description string, modified string, subjects array<string>, body_paras int, schedule_paras int, extent string"


def metadata_row(xml: str | None) -> list[dict]:
    """One record of a law's introduction."""
    root = parse(xml)
    if root is None:
        return []
    first = lambda tag: text_of(next(iter(root.iter(tag)), None))
    value = lambda tag: next((int(n.get("Value")) for n in root.iter(tag) if (n.get("Value") or "").isdigit()), None)
    extent = next((n.get("RestrictExtent") for n in root.iter() if n.get("RestrictExtent")), None)
    return [{"title": first("title"), "description": first("description"), "modified": first("modified"), "subjects": [s for s in (text_of(n) for n in root.iter("subject")) if s], "body_paras": value("BodyParagraphs"), "schedule_paras": value("ScheduleParagraphs"), "extent": extent}]


ENACTING_ROW = "text string, urls map<string,array<string>>"


def enacting_row(xml: str | None) -> list[dict]:
    """The clause under which a law was made, and the links behind its reference
    marks: those in a footnote of that mark, and of citations their own."""
    root = parse(xml)
    if root is None:
        return []
    text = " ".join(t for t in (text_of(n) for tag in ("IntroductoryText", "EnactingText") for n in root.iter(tag)) if t)
    urls: dict[str, list[str]] = {}
    for note in root.iter("Footnote"):
        urls[note.get("id") or ""] = [c.get("URI") for c in note.iter("Citation") if c.get("URI")]
    for c in root.iter("Citation"):
        if c.get("id") and c.get("URI"):
            urls.setdefault(c.get("id"), []).append(c.get("URI"))
    return [{"text": text or None, "urls": {k: v for k, v in urls.items() if k and v}}]


REPEAL_ROW = "title string, revoked boolean, revoking array<string>"


def repeal_row(xml: str | None) -> list[dict]:
    """Whether a law's title says that it is repealed or revoked, and the links
    of the laws that its notes name as doing so."""
    root = parse(xml)
    if root is None:
        return []
    title = text_of(next(iter(root.iter("title")), None))
    gone = bool(re.search(r"\((?:repealed|revoked)", title or "", re.I))
    notes = [n for n in root.iter("Commentary") if re.search(r"\b(?:repealed|revoked)\b", text_of(n) or "", re.I)]
    return [{"title": title, "revoked": gone, "revoking": list(dict.fromkeys(c.get("URI") for n in notes for c in n.iter("Citation") if c.get("URI")))}]


SECTION_ROW = "section_ref string, text string"


def section_rows(xml: str | None) -> list[dict]:
    """Top provisions with their whole text; a missing id falls back to its number."""
    root = parse(xml)
    found = [(n.get("id") or f"section-{i}", text_of(n)) for i, n in enumerate(root.iter("P1") if root is not None else (), 1)]
    return [{"section_ref": i, "text": t} for i, t in found if t]


TEXT_ROW = "text string"


def document_text(xml: str | None) -> list[dict]:
    root = parse(xml)
    return [{"text": text_of(root)}] if root is not None else []


class _Cells(HTMLParser):
    """Rows of cells of every table body; each cell has its text and first link."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, str | None]]] = []
        self.cell: list[str] | None = None
        self.link: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag == "td":
            self.cell, self.link = [], None
        elif tag == "a" and self.cell is not None and self.link is None:
            self.link = dict(attrs).get("href")

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag == "td" and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((_SPACES.sub(" ", "".join(self.cell)).strip(), self.link))
            self.cell = None


CHANGE_ROW = "name string, title_en string, path string, target string, affect string, applied string"
#: Cells of a table of changes: the changed law with its link, its part and effect, the changing law, and whether it is applied.
CHANGED, TARGET, AFFECT, CHANGING, APPLIED = 0, 2, 3, 4, 7


def change_rows(html: str | None, of_changed: bool = True) -> list[dict]:
    """Rows of a page's table of changes. The other law is the changed one on a
    page of what a law changes, else the changing one; rows of which the other
    law has no readable link are left out."""
    if not html:
        return []
    p = _Cells()
    p.feed(html)
    out = []
    for row in p.rows:
        if len(row) < 9:
            continue
        title, link = row[CHANGED if of_changed else CHANGING]
        link = link or row[(CHANGED if of_changed else CHANGING) + 1][1]
        m = re.search(r"/(?:id/)?([a-z]+)/(\d{4})/(\d+)", link or "")
        if m:
            out.append({"name": f"UK_{m[1]}_{m[2]}_{m[3]}", "title_en": title, "path": m[0].replace("/id", ""), "target": row[TARGET][0], "affect": row[AFFECT][0], "applied": row[APPLIED][0]})
    return out


class _Listing(HTMLParser):
    """Records of a listing: a link in a sixth-level heading opens one, the paragraph behind describes it."""

    def __init__(self) -> None:
        super().__init__()
        self.records: list[dict] = []
        self.at: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "h6":
            self.at = "h6"
        elif tag == "a" and self.at == "h6":
            self.records.append({"path": dict(attrs).get("href"), "title_en": "", "description": ""})
            self.at = "title_en"
        elif tag == "p" and self.records:
            self.at = "description"

    def handle_data(self, data):
        if self.at in ("title_en", "description"):
            self.records[-1][self.at] += data

    def handle_endtag(self, tag):
        if tag in ("a", "p", "h6"):
            self.at = None


LISTING_ROW = "path string, title_en string, description string"


def listing_rows(html: str | None) -> list[dict]:
    """Newest entries of a listing, last one first."""
    if not html:
        return []
    p = _Listing()
    p.feed(html)
    return [{k: _SPACES.sub(" ", v).strip() or None if v else None for k, v in r.items()} for r in reversed(p.records)]


def has_table(html: F.Column) -> F.Column:
    """Whether a page has a table body at all: a built-in check before parsing."""
    return html.rlike(r"(?is)<tbody\b.*?</tbody>")


def shred(pages: DataFrame, keys: list[str], column: str, rows: Callable[[str | None], list[dict]], schema: str) -> DataFrame:
    """``keys`` and the rows that a parser makes of each page."""
    source = pages.select(*keys, column)
    made = T.StructType.fromDDL(schema)
    out = T.StructType([*[source.schema[k] for k in keys], *made])
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            values: list[list] = [[] for _ in made]
            for i, page in enumerate(b.column(len(keys)).to_pylist()):
                for row in rows(page):
                    at.append(i)
                    for v, f in zip(values, made, strict=True):
                        cell = row[f.name]
                        v.append(list(cell.items()) if isinstance(cell, dict) else cell)
            taken = pa.array(at, pa.int32())
            cells = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(j).take(taken) for j in range(len(keys))], *cells], names=[f.name for f in out])

    return source.mapInArrow(run, out)
