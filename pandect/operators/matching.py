"""Matching texts against ordered vocabularies, and references to links.

Vocabularies are parameters: small ordered lists of (name, terms or
patterns). Order matters, the first match wins; it is a CASE chain, so one
pass over the rows and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandect.functions.citations import is_enabling, law_of_url


def excluded(title: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern matches: one alternation instead of many."""
    return F.coalesce(title.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def first_match(text: Column, vocabulary: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Name of the first entry of which a term occurs in the text, whatever its case."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, terms in reversed(list(vocabulary)):
        hit = F.lit(False)
        for t in terms:
            hit = hit | low.contains(t.lower())
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def codes_of(c: Column) -> Column:
    """Codes in upper case from text that lists them with commas or semicolons,
    without the nations behind them, sorted and distinct."""
    parts = F.transform(F.split(F.upper(c), "[;,]"), lambda x: F.trim(x))
    nations = ("ENGLAND AND WALES", "ENGLAND & WALES", "ENGLAND", "WALES", "SCOTLAND", "NORTHERN IRELAND", "")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~x.isin(*nations))))


def family_of_codes(codes: Column, families: dict[str, str]) -> Column:
    """Family of the first code that has one."""
    table = F.create_map(*[F.lit(x) for pair in families.items() for x in pair]) if families else None
    if table is None:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.transform(codes, lambda x: table[x]), lambda x: x.isNotNull()), F.lit(0))


def three_way(df: DataFrame, title: str, codes: str, families: dict[str, str], vocabulary, patterns) -> DataFrame:
    """``group``: 1 for a known code, 2 for a matching term, 3 for the rest and
    for excluded titles; ``family`` from the code or the term."""
    by_code = family_of_codes(F.col(codes), families)
    by_term = first_match(F.col(title), vocabulary)
    out = excluded(F.col(title), patterns)
    group = F.when(out, 3).when(by_code.isNotNull(), 1).when(by_term.isNotNull(), 2).otherwise(3)
    return df.withColumn("group", group).withColumn("family", F.when(group == 1, by_code).when(group == 2, by_term))


def selected(df: DataFrame, flag: str) -> DataFrame:
    """The rows that are selected, or all of them if none is."""
    any_one = df.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("a")).select("a").scalar()
    return df.where(F.coalesce(F.col(flag), F.lit(False)) | ~any_one)


def specific(text: Column, acts: Sequence[tuple[str, str]]) -> Column:
    """Ids of the acts whose pattern a text matches."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(i)) for p, i in acts]))


def clause_of(text: Column, start: str, longest: int | None = None) -> Column:
    """From a phrase to the first full stop before a capital, else to the end of
    the text, or ``longest`` characters if that is given."""
    rest = F.regexp_extract(text, rf"(?s)({start}.*)$", 1)
    ended = F.regexp_extract(rest, r"(?s)^(.*?\.)\s+[A-Z]", 1)
    return F.when(rest != "", F.when(ended != "", ended).otherwise(rest if longest is None else F.substring(rest, 1, longest)))


def links_of_references(clause: Column, urls: Column, host: str, pattern: str = r"\b([fc]\d{5})\b") -> Column:
    """Laws behind the reference marks of a clause (``urls`` maps a mark to its
    links), only those that others can be made under, in order. Links of
    citations (marks beginning with c) are preferred; of a footnote only the
    first link counts."""
    marks = F.array_distinct(F.regexp_extract_all(clause, F.lit(pattern), F.lit(1)))
    laws = lambda m, n: F.transform(F.slice(urls[m], 1, n) if n else urls[m], lambda u: law_of_url(u, host))
    of = lambda prefix, n: F.flatten(F.transform(F.filter(marks, lambda m: m.startswith(prefix) & F.map_contains_key(urls, m)), lambda m: laws(m, n)))
    good = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & is_enabling(x)))
    cited = good(of("c", 0))
    return F.when(F.size(cited) > 0, cited).otherwise(good(of("f", 1)))


def links_with_years(text: Column, links: Column) -> Column:
    """Links that contain one of the years a text mentions."""
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))
    return F.filter(links, lambda u: F.exists(years, lambda y: u.contains(y)))
