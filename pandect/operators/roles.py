"""Actors in provisions, and the clauses that give them duties and powers.

Finding is consuming: patterns are tried in the order of a library, and what
one matches is taken out before the next is tried, which SQL functions can't
express; so this part runs in Arrow-batched Python. Libraries are parameters;
``library_from_names`` makes one by rule from names such as "Gvt: Upland Board".
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge of an actor's name: a blank or a punctuation mark.
EDGE = r"[\s\p{P}\p{S}]"
#: Characters that a pattern allows between an actor and its modal, and for the action behind it. Fixed values.
BEFORE, BEHIND = 150, 200
#: Characters before and behind a modal that a search in windows looks at.
WINDOW = (400, 200)
#: Modal per kind of rule, for actors that are bound and for those that govern. Fixed values.
KINDS = {"DUTY": (False, r"(?:shall|must)(?!\s+have the power)"), "RIGHT": (False, r"may(?!\s+not|\s+be)"), "RESPONSIBILITY": (True, r"(?:shall|must)(?!\s+have the power)"), "POWER": (True, r"may(?!\s+not|\s+be)")}
MODAL = regex.compile(r"\b(?:shall|must|may)\b", regex.I)


def library_from_names(names: Sequence[str]) -> list[tuple[str, str]]:
    """(name, pattern) for names "Kind: Words": each word with either case of
    its first letter, the last in singular or plural. Longer names come first,
    so that a part of a name doesn't take its text."""
    out = []
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        words = name.split(":")[-1].split()
        parts = [f"[{w[0].upper()}{w[0].lower()}]{regex.escape(w[1:])}" if w[0].isalpha() else regex.escape(w) for w in words]
        out.append((name, " ".join(parts) + "s?"))
    return out


def governs(name: str) -> bool:
    return name.startswith(("Gvt:", "EU:")) or name == "Crown"


def actors_in(text: str | None, library: Sequence[tuple[str, regex.Pattern]]) -> list[str]:
    """Names found, sorted; each match is removed before the next pattern is tried."""
    if not text:
        return []
    text, found = f" {text} ", set()
    for name, pattern in library:
        if m := pattern.search(text):
            found.add(name)
            text = text[: m.start()] + text[m.end() :]
    return sorted(found)


def windows(text: str, large: int | None = None) -> list[tuple[int, int]]:
    """All of a text, or, if it has more than ``large`` characters, stretches
    around its modals, overlapping ones united: faster, but an actor farther
    from its modal than a window isn't seen."""
    if large is None or len(text) <= large:
        return [(0, len(text))]
    out: list[tuple[int, int]] = []
    for m in MODAL.finditer(text):
        a, b = max(0, m.start() - WINDOW[0]), min(len(text), m.end() + WINDOW[1])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def refine(text: str, modal: tuple[int, int], longest: int | None = None) -> str:
    """One line around a modal (its start and end): from the start of its
    sentence to the end of its action; if ``longest`` is given, at most so many
    characters, cut at a word."""
    start = max((m.end() for m in regex.finditer(r"[.;]\s+(?=\p{Lu})", text[: modal[0]])), default=0)
    end = regex.search(r"[.;](?=\s|$)", text[modal[1] :])
    text = " ".join((text[start : modal[1] + end.end()] if end else text[start:]).split())
    if longest is not None and len(text) > longest:
        text = text[: longest - 3].rsplit(" ", 1)[0]
    return text if text.endswith((".", ";", "!", "?", ")")) else text.rstrip(" ,") + "..."


def rule_patterns(library: Sequence[tuple[str, str]]) -> list[tuple[str, str, regex.Pattern]]:
    """(name, kind, pattern) of every actor and each kind of rule it can have."""
    return [
        (name, kind, regex.compile(rf"(?:^|{EDGE})(?:{actor})(?={EDGE})[^—.]{{0,{BEFORE}}}?\b(?P<modal>{modal})[,\s—]+(?P<action>(?s:.){{1,{BEHIND}}})?"))
        for name, actor in library
        for kind, (government, modal) in KINDS.items()
        if government == governs(name)
    ]


def first_patterns(library: Sequence[tuple[str, str]]) -> list[tuple[str, str, regex.Pattern]]:
    """The first version of the rules: an actor anywhere before its modal in the
    same sentence, or behind a passive ("must be kept by the actor"); actions
    aren't captured."""
    out = []
    for name, actor in library:
        for kind, (government, modal) in KINDS.items():
            if government == governs(name):
                out.append((name, kind, regex.compile(rf"(?:^|{EDGE})(?:{actor})(?={EDGE})[^—.]*?\b(?P<modal>{modal})\b(?P<action>(?!))?")))
                out.append((name, kind, regex.compile(rf"\b(?P<modal>{modal.replace('|' + chr(92) + 's+be', '')})\s+be\s[^—.]*?\bby\s(?:the\s|an?\s)?(?:{actor})(?={EDGE})(?P<action>(?!))?")))
    return out


def clauses_in(text: str | None, patterns: Sequence[tuple[str, str, regex.Pattern]], large: int | None = None, longest: int | None = None) -> list[tuple[str, str, str, bool]]:
    """(name, kind, clause, action seen) of the rules in a text. Of actors with
    the same clause the one with the longest name is kept, the first of equals."""
    if not text or not MODAL.search(text):
        return []
    best: dict[tuple[str, str], tuple[str, str, str, bool]] = {}
    for name, kind, pattern in patterns:
        for a, b in windows(text, large):
            # Overlapping matches: what one takes for its action may hold the next rule.
            for m in pattern.finditer(text, a, b, overlapped=True):
                base = max(0, m.start() - 100)
                clause = refine(text[base : m.end()], (m.start("modal") - base, m.end("modal") - base), longest)
                key = (kind, clause.lower())
                if key not in best or len(name) > len(best[key][0]):
                    best[key] = (name, kind, clause, m.group("action") is not None)
    return sorted(best.values())


def _compiled(library: Sequence[tuple[str, str]]) -> list[tuple[str, regex.Pattern]]:
    return [(n, regex.compile(f"{EDGE}(?:{p}){EDGE}")) for n, p in library]


def with_actors(df: DataFrame, text: str, library: Sequence[tuple[str, str]]) -> DataFrame:
    """``df`` with the actors of a text: ``role`` (bound) and ``role_gvt`` (governing)."""

    @F.pandas_udf("role array<string>, role_gvt array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _compiled([x for x in library if not governs(x[0])])
        gvt = _compiled([x for x in library if governs(x[0])])
        for s in batches:
            yield pd.DataFrame({"role": s.map(lambda t: actors_in(t, own)), "role_gvt": s.map(lambda t: actors_in(t, gvt))})

    both = df.select("*", run(F.col(text)).alias("__actors"))
    return both.select(*df.columns, "__actors.role", "__actors.role_gvt")


CLAUSE = "array<struct<holder:string,duty_type:string,clause:string,captured:boolean>>"


def clauses(text: Column, library: Sequence[tuple[str, str]], large: int | None = None, longest: int | None = None, version: int = 2) -> Column:
    """Rules of a text as an array of ``CLAUSE`` structs, by either version of
    the patterns. Texts without any
    modal don't leave the JVM with their words."""

    @F.pandas_udf(CLAUSE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        patterns = (rule_patterns if version == 2 else first_patterns)(library)  # once per task
        for s in batches:
            yield s.map(lambda t: [dict(zip(("holder", "duty_type", "clause", "captured"), c, strict=True)) for c in clauses_in(t, patterns, large, longest)])

    return run(F.when(text.rlike(r"(?i)\b(?:shall|must|may)\b"), text))


def merged_by_law(rows: DataFrame) -> DataFrame:
    """Rules of a law's units as one document per law: distinct entries, sorted
    holders and articles. Entries are distinct before they are gathered."""
    one = rows.select("law_name", "article", F.explode("rules").alias("r")).select("law_name", "article", "r.*").distinct()
    # One document per law is the result asked for, so a law's distinct rules meet in one row.
    entry = F.struct("holder", "duty_type", "clause", "article")
    return one.groupBy("law_name").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.array_sort(F.collect_set("holder")).alias("holders"), F.array_sort(F.collect_set("article")).alias("articles"), F.array_sort(F.collect_set("duty_type")).alias("duty_types"))
