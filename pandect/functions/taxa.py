"""Rule-based classification of provisions: cleaning, purposes, management
categories, making detection, clause confidence. All of it is Catalyst.

Purposes and categories are told by vocabularies: plain terms per name, from
which ``pattern_of`` makes one pattern by rule. The vocabularies here are
defaults; every function takes another.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vocabulary = Mapping[str, Sequence[str]]

#: Phrases that look like actors or rules but are neither.
NOISE = ("public interest", "public function", "public service", "public sewer", "representative of", "as the case may be", "may be approved", "may be required", "may reasonably require", "waste from households")

#: Names of the purposes in their order (fixed values), each with terms that show it.
PURPOSES: Vocabulary = {
    "Enactment+Citation+Commencement": ("may be cited", "is cited", "come* into force", "come* into operation", "commence*", "takes effect"),
    "Interpretation+Definition": ("mean*", "interpret*", "defin*", "is to be read", "has the same sense", "expression", "in this act", "in this order", "in this schedule", "in this regulation", "in this part"),
    "Application+Scope": ("appl*", "has effect", "without prejudice", "binds the crown", "nothing in"),
    "Extent": ("extend* to", "extent", "england and wales", "northern ireland"),
    "Exemption": ("exempt*",),
    "Process+Rule+Constraint+Condition": ("shall", "must", "require*", "obligation", "procedure", "condition", "duty", "duties", "compl*", "prohibit*", "permit*", "may not", "ensure", "maintain"),
    "Power Conferred": ("power to", "power of", "powers", "confer*", "exercis*"),
    "Charge+Fee": ("fee", "charge", "payable"),
    "Offence": ("offence", "penalt*"),
    "Enforcement+Prosecution": ("prosecut*", "proceeding", "convict*", "enforce*"),
    "Defence+Appeal": ("appeal", "defence", "not guilty"),
    "Liability": ("liabilit*", "liable"),
    "Repeal+Revocation": ("repeal*", "revo*", "cease* to have effect"),
    "Amendment": ("amend*", "substitut*", "insert*", "omit*"),
    "Transitional Arrangement": ("transition*", "saving", "until the new"),
}
DEFAULT_PURPOSE = "Process+Rule+Constraint+Condition"

#: Names of the management categories in their order (fixed values), each with terms that show it.
CATEGORIES: Vocabulary = {
    "Policy": ("polic*", "objective", "strateg*"),
    "Organisation": ("appoint*", "organisation chart"),
    "Organisation - Control": ("procedure", "process*", "instruction", "supervis*", "responsible for", "control of"),
    "Organisation - Communication & Consultation": ("consult*", "communicat*", "inform", "publish*", "report to", "copy to"),
    "Organisation - Collaboration, Coordination, Cooperation": ("collaborat*", "coordinat*", "co-ordinat*", "cooperat*", "co-operat*"),
    "Organisation - Competence": ("competen*", "train*", "skill*", "qualif*"),
    "Organisation - Costs": ("cost", "fee", "charge", "expense"),
    "Records": ("record", "register", "logbook", "inventor*", "document", "certificate", "label*", "log"),
    "Permit, Authorisation, License": ("permit", "authoris*", "licen*"),
    "Notification": ("notif*", "notice", "application for"),
    "Planning & Risk / Impact Assessment": ("plan", "planning", "assess*"),
    "Aspects and Hazards": ("hazard*", "danger*", "aspect"),
    "Risk Control": ("risk", "reasonable step", "reasonable care", "precaution", "corrective", "prevent*", "safety of"),
    "Maintenance, Examination and Testing": ("maint*", "examin*", "test*", "inspect*", "calibrat*", "good repair"),
    "Checking, Monitoring": ("check*", "monitor*", "measur*", "at intervals"),
    "Review": ("review*", "revis*"),
}


def pattern_of(terms: Sequence[str]) -> str:
    """One pattern, without regard to case, for plain terms: whole words, a
    plural allowed at the end, any blanks between words; ``*`` stands for any
    ending of a word."""

    def one(term: str) -> str:
        words = [re.escape(w.rstrip("*")) + (r"\w*" if w.endswith("*") else "") for w in term.split()]
        return r"\s+".join(words) + ("" if term.endswith("*") else "s?")

    return r"(?i)\b(?:" + "|".join(one(t) for t in terms) + r")\b"


# Kinds of rule that get the fallback category if no pattern shows another.
CATEGORY_RULES = ("Duty", "Right", "Responsibility", "Discretionary", "Process, Rule, Constraint, Condition")
FALLBACK_CATEGORY = "Risk Control"

# Fixed values of making detection: (tier, signal, makes rules, confidence, text of the title).
TITLE_SIGNALS = (
    (2, "title_revocation", False, 0.98, "(Revocation"),
    (2, "title_consequential", False, 0.90, "(Consequential"),
    (2, "title_repeal", False, 0.92, "(Repeal"),
    (2, "title_amendment", False, 0.80, "(Amendment"),
    (2, "title_transitional", False, 0.75, "(Transitional"),
    (2, "title_directive", False, 0.85, "Directive"),
    (2, "title_scheme", False, 0.70, "Scheme"),
)
POSITIVE_TITLE_SIGNALS = ((2, "title_regulations", 0.55, "Regulations"), (2, "title_rules", 0.35, "Rules"))
DESCRIPTION_SIGNALS = (
    ("provision_securing", True, 0.90, "to make provision for securing"),
    ("provision_for", True, 0.70, "to make provision for"),
    ("to_require", True, 0.80, "to require"),
    ("to_prohibit", True, 0.80, "to prohibit"),
    ("to_regulate", True, 0.75, "to regulate"),
    ("to_impose", True, 0.80, "to impose"),
    ("to_establish", True, 0.70, "to establish"),
    ("to_create", True, 0.70, "to create"),
    ("desc_to_amend", False, 0.75, "to amend the"),
    ("desc_give_effect", False, 0.65, "to give effect to"),
    ("desc_powers_conferred", False, 0.55, "in exercise of the powers conferred by"),
)
PRIOR = 0.173
TIER_WEIGHTS = {1: 0.95, 2: 0.75, 3: 0.50, 4: 0.65}
MAKING_FROM, NOT_MAKING_TO = 0.70, 0.30


def clean(text: Column, noise: Sequence[str] = NOISE) -> Column:
    """Without the phrases of ``noise``, each replaced by a blank."""
    return F.regexp_replace(text, pattern_of(noise), " ")


def shown(text: Column, vocabulary: Vocabulary) -> Column:
    """Names of a vocabulary, in its order, of which a text holds a term."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern_of(terms)), name) for name, terms in vocabulary.items()]))


def purposes(text: Column, vocabulary: Vocabulary = PURPOSES, default: str = DEFAULT_PURPOSE) -> Column:
    """Purposes that a text shows, in their order; the default if none; null
    and empty text has none at all."""
    found = shown(text, vocabulary)
    named = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(named)


def categories(text: Column, rules: Column | None = None, vocabulary: Vocabulary = CATEGORIES) -> Column:
    """Management categories of a text in their order; with ``rules`` (kinds of
    rule that the text holds) the fallback where no term shows another."""
    found = shown(text, vocabulary)
    if rules is not None:
        relevant = F.arrays_overlap(rules, F.array(*[F.lit(r) for r in CATEGORY_RULES]))
        found = F.when((F.size(found) == 0) & F.coalesce(relevant, F.lit(False)), F.array(F.lit(FALLBACK_CATEGORY))).otherwise(found)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(found)


def in_order(values: Column, order) -> Column:
    """Values of a vocabulary in its order; others are left out."""
    return F.array_compact(F.array(*[F.when(F.array_contains(values, v), v) for v in order]))


def signals(title: Column, description: Column, body: Column, schedule: Column) -> Column:
    """Signals for and against a law's making rules: ``array<struct<tier, signal, making, confidence>>``."""

    def one(tier: int, name: str, making: bool, confidence, when: Column) -> Column:
        conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        return F.when(when, F.struct(F.lit(tier).alias("tier"), F.lit(name).alias("signal"), F.lit(making).alias("making"), conf.alias("confidence")))

    excluded = reduce(lambda a, b: a | b, [title.contains(t) for _, _, _, _, t in TITLE_SIGNALS[:5]])
    low = F.lower(description)
    appointed = title.contains("(Appointed Day")
    return F.array_compact(
        F.array(
            one(1, "title_appointed_day", False, 1.0, appointed),
            one(1, "title_commencement", False, 0.99, ~appointed & title.contains("(Commencement")),
            *[one(t, n, m, c, title.contains(x)) for t, n, m, c, x in TITLE_SIGNALS],
            *[one(t, n, True, c, ~excluded & title.contains(x)) for t, n, c, x in POSITIVE_TITLE_SIGNALS],
            one(3, "low_body_high_schedule", False, 0.90, (body <= 3) & (schedule > 50)),
            one(3, "high_body_paras", True, F.round(F.least(F.lit(0.85), F.lit(0.5) + body / F.lit(500.0)), 2), body > 50),
            one(3, "moderate_body_paras", True, 0.40, body.between(11, 50)),
            one(3, "very_low_body_paras", False, 0.60, body <= 5),
            *[one(4, n, m, c, low.contains(x)) for n, m, c, x in DESCRIPTION_SIGNALS],
        )
    )


def making_score(found: Column) -> Column:
    """Score from the prior: first every signal against, then every one for, by tier."""
    weight = F.create_map(*[F.lit(x) for pair in TIER_WEIGHTS.items() for x in pair])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["making"].alias("making"), s["tier"].alias("tier"), (s["confidence"] * weight[s["tier"]]).alias("w"))))
    step = lambda acc, s: F.when(s["making"], acc + (F.lit(1.0) - acc) * s["w"]).otherwise(acc * (F.lit(1.0) - s["w"]))
    return F.round(F.aggregate(ordered, F.lit(PRIOR), step), 4)


def making_class(score: Column) -> Column:
    return F.when(score >= MAKING_FROM, "making").when(score <= NOT_MAKING_TO, "not_making").otherwise("uncertain")


def clause_confidence(clause: Column, captured: Column) -> Column:
    """Confidence in an extracted clause by what is seen of it; 0 without one."""
    parts = ((captured, 0.25), (~clause.endswith("..."), 0.25), (F.length(clause) > 30, 0.20), (clause.rlike(r"(?i)\b(?:shall|must)\b"), 0.15))
    total = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(F.coalesce(clause, F.lit("")) == "", 0.0).otherwise(F.round(total, 2))


def with_article_bonus(confidence: Column) -> Column:
    return F.least(confidence + 0.15, F.lit(1.0))


def is_making(rules: Column) -> Column:
    return F.coalesce(F.arrays_overlap(rules, F.array(F.lit("Duty"), F.lit("Responsibility"))), F.lit(False))
