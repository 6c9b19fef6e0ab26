"""Documents that older exports carry as lines of text, made nested again.

Each format is a list of (kind, pattern) that labels its lines, and a fold
over the labelled lines. Folds run in Arrow-batched Python: state carries from
line to line, which array functions could only do in quadratic time. Lines
that fit no pattern are skipped; null and empty texts give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pandect.functions.citations import lookup

Format = Sequence[tuple[str, str]]

#: Holders' rules: a holder in brackets, a link, a kind of rule, and clauses. Fixed values.
RULES: Format = (
    ("holder", r"^\[([^\]]+)\]$"),
    ("article", r"^https?://\S+?/\w+/\d+/\d+/(\S+)$"),
    ("kind", r"^(DUTY|RIGHT|POWER|RESPONSIBILITY)$"),
    ("clause", "^\U0001f4cc\\s*(.*)$"),
)
#: Changes per law: a number with a title, a link, and lines of changes. Fixed values.
STATS: Format = (
    ("law", r"^(\d+ - .*)$"),
    ("link", r"^(https?://\S+)$"),
    ("change", r"^(.+)$"),
)
#: Change logs: a date, a field's name, and old and new value. Fixed values.
LOG: Format = (
    ("date", r"^(\d{1,2}/\d{1,2}/\d{4})$"),
    ("field", "^((?:\U0001f53a|\U0001f53b).*|Amended_by|Amending|Rescinded_by|Rescinding)$"),
    ("value", r"^(.+)$"),
)


def labelled(text: str, form: Format) -> Iterator[tuple[str, str]]:
    """(kind, content) of every line that a pattern fits, the first that does."""
    compiled = [(k, re.compile(p)) for k, p in form]
    for line in text.split("\n"):
        line = line.strip()
        if line:
            hit = next(((k, m) for k, p in compiled if (m := p.match(line))), None)
            if hit:
                yield hit[0], hit[1].group(1).strip()


def rules_of(text: str, default: str) -> list[dict] | None:
    """Entries of holders' rules; a clause without an article gives none, and a
    kind holds for one clause."""
    seen = {"holder": None, "article": None, "kind": None}
    out = []
    for kind, content in labelled(text, RULES):
        if kind == "clause":
            if seen["holder"] and seen["article"]:
                out.append({"holder": seen["holder"], "article": seen["article"], "duty_type": seen["kind"] or default, "clause": content or None})
            seen["kind"] = None
        else:
            if kind == "holder":
                seen = dict.fromkeys(seen)
            seen[kind] = content
    return out or None


def stats_of(text: str, affects: re.Pattern) -> dict[str, dict] | None:
    """Law to its title, link, number of changes and details. A law without a
    link is left out; the applied mark is in brackets at a line's end, and what
    ``affects`` finds at the end before it is the effect."""
    out: dict[str, dict] = {}
    law: dict | None = None
    for kind, content in labelled(text, STATS):
        if kind == "law":
            count, _, title = content.partition(" - ")
            law = {"name": None, "title": title, "url": None, "count": int(count), "details": []}
        elif kind == "link" and law is not None and law["url"] is None:
            law["url"] = content
            parts = re.search(r"([a-z]+)/(\d{4})/(\d+)", content)
            if parts:
                law["name"] = "UK_" + "_".join(parts.groups())
                out[law["name"]] = law
        elif law is not None and law["url"]:
            applied = re.search(r"\s*\[([^\]]+)\]$", content)
            rest = content[: applied.start()] if applied else content
            effect = affects.search(rest)
            target = rest[: effect.start()].strip() if effect else rest
            if effect and not target:
                effect, target = None, rest
            law["details"].append({"target": target, "affect": effect.group(1) if effect else None, "applied": applied.group(1) if applied else None})
    return out or None


def log_of(text: str) -> list[dict] | None:
    """Entries of a change log, in order; a field's value is the line behind it."""
    out: list[dict] = []
    field = None
    for kind, content in labelled(text, LOG):
        if kind == "date":
            day, month, year = content.split("/")
            out.append({"timestamp": f"{year}-{int(month):02d}-{int(day):02d}T00:00:00Z", "source": "legacy_import", "changed_by": None, "summary": None, "changes": {}})
            field = None
        elif out and field is None and kind == "field":
            field = re.sub("^\U0001f53a_stats_", "amending_stats_", re.sub("^\U0001f53b_stats_", "amended_by_stats_", content)).lower()
        elif out and field is not None:
            old, arrow, new = content.partition(" -> ")
            value = lambda x: None if x in ("nil", "") else x
            out[-1]["changes"][field] = {"old": value(old) if arrow else None, "new": value(new if arrow else content)}
            field = None
    for e in out:
        n = len(e["changes"])
        e["summary"] = f"Updated {n} field{'s' * (n != 1)}: {', '.join(sorted(e['changes']))}" if n else "No changes"
    return out or None


def _mapped(fn: Callable[[str], object], kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: fn(t) if t else None)

    return run


ENTRIES = "array<struct<holder:string,article:string,duty_type:string,clause:string>>"
STAT = "struct<name:string,title:string,url:string,count:int,details:array<struct<target:string,affect:string,applied:string>>>"
LOG_ENTRY = "struct<timestamp:string,source:string,changed_by:string,summary:string,changes:map<string,struct<old:string,new:string>>>"


def rules_from_text(text: Column, default: str) -> Column:
    return _mapped(lambda t: rules_of(t, default), ENTRIES)(text)


def affect_pattern(words: Sequence[str]) -> str:
    """Pattern of an effect at the end of a line, longest words first."""
    return rf"(?i)(?:^|\s)((?:{'|'.join(re.escape(w) for w in sorted(words, key=len, reverse=True))})\b[^\[\]]*)$"


def stats_from_text(text: Column, words: Sequence[str]) -> Column:
    pattern = re.compile(affect_pattern(words))
    return _mapped(lambda t: stats_of(t, pattern), f"map<string,{STAT}>")(text)


def log_from_text(text: Column) -> Column:
    return _mapped(log_of, f"array<{LOG_ENTRY}>")(text)


def split_affects(stats: Column, words: Sequence[str]) -> Column:
    """Details of a map of statistics whose effect still stands in the target,
    split; no shuffle, as nothing leaves its row."""
    alternatives = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    pattern = rf"(?i)^(.+?)\s+((?:{alternatives})\b[^\[\]]*?)\s*$"

    def fixed(d: Column) -> Column:
        hit = d["affect"].isNull() & d["target"].rlike(pattern)
        part = lambda i, other: F.when(hit, F.trim(F.regexp_extract(d["target"], pattern, i))).otherwise(other)
        return F.struct(part(1, d["target"]).alias("target"), part(2, d["affect"]).alias("affect"), d["applied"].alias("applied"))

    return F.transform_values(stats, lambda k, v: F.when(v.isNotNull(), F.struct(v["name"].alias("name"), v["title"].alias("title"), v["url"].alias("url"), v["count"].alias("count"), F.transform(v["details"], lambda d: F.when(d.isNotNull(), fixed(d))).alias("details"))))


def renamed(values: Column, names: dict[str, str]) -> Column:
    """Values by a table of new names; others stay."""
    return F.transform(values, lambda v: F.coalesce(lookup(names, v), v))


def plus_separated(value: Column) -> Column:
    """Compound values with a plus sign instead of commas or spaced plus signs."""
    return F.regexp_replace(value, r"\s*(?:,|\+)\s*", "+")


def line_ends(text: Column, placeholder: str) -> Column:
    return F.replace(text, F.lit(placeholder), F.lit("\n"))
