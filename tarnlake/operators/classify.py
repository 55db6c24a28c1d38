"""Classifiers that a configuration describes: ordered term rules, weighted fields, capped evidence, checks and bands.

A classifier is data - term lists, weights, thresholds - and compiles to one expression of built-in functions, so any
number of them stays in one scan of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """Folded text holds a term: terms of several words or with a hyphen anywhere, single words as whole words."""
    plain, whole = [t.lower() for t in terms if re.search(r"[\s-]", t)], [t.lower() for t in terms if not re.search(r"[\s-]", t)]
    out = F.lit(False)
    for t in plain:
        out = out | F.contains(text, F.lit(t))
    if whole:
        out = out | text.rlike(rf"(?<!\w)(?:{'|'.join(map(re.escape, whole))})(?!\w)")
    return out


def ordered(text: Column, classes: Sequence[tuple[str, Sequence[str]]], default: str, *, veto: Sequence[str] = ()) -> Column:
    """The first class with a term in the text; a veto term gives the default at once."""
    cases = [*([(veto, default)] if veto else []), *[(terms, name) for name, terms in classes]]
    return T.once(text, lambda t: rules.cascade([(has_any(t, terms), name) for terms, name in cases], default))


def any_labels(text: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """All classes with a term in the text, in order."""
    return T.once(text, lambda t: F.filter(F.array(*[F.when(has_any(t, terms), F.lit(name)) for name, terms in classes.items()]), lambda x: x.isNotNull()))


def capped(text: Column, groups: Sequence[tuple[Sequence[str], float, float]], low: float = 0.0, high: float = 1.0) -> Column:
    """Sum over groups of (terms, weight, cap): weight for each term held, at most the cap; kept within limits."""

    def total(t: Column) -> Column:
        return sum((F.least(F.lit(float(cap)), F.size(T.hits(t, terms)) * F.lit(float(weight))) for terms, weight, cap in groups), F.lit(0.0))

    return F.greatest(F.lit(low), F.least(F.lit(high), T.once(text, total)))


def weighted_fields(fields: Mapping[str, tuple[Column, int]], classes: Mapping[str, Sequence[str]], *, accept: int, margin: int, default: str, tie: str = "given") -> Column:
    """struct(label, score, runner_up): fields are (folded text, weight); a phrase counts up to 3 times in each.

    The best class is accepted from `accept` on, and if it leads by `margin`. Ties go to the class given first, or by name
    up ("name") or down ("name_desc").
    """
    names = list(classes) if tie == "given" else sorted(classes, reverse=tie == "name_desc")

    def counted(x: Column) -> Column:
        total = lambda name: sum((F.least(T.phrase_count(x[i], p), F.lit(3)) * weight for i, (_, weight) in enumerate(fields.values()) for p in classes[name]), F.lit(0))
        return F.sort_array(F.array(*[F.struct((-total(name)).cast("int").alias("minus"), F.lit(rank).alias("rank"), F.lit(name).alias("name")) for rank, name in enumerate(names)]))

    def judged(order: Column) -> Column:
        score, second = -order[0]["minus"], (-order[1]["minus"] if len(names) > 1 else F.lit(0))
        label = F.when((score >= accept) & (score - second >= margin), order[0]["name"]).otherwise(F.lit(default))
        return F.struct(label.alias("label"), score.alias("score"), second.alias("runner_up"))

    return T.once(T.once(F.array(*[text for text, _ in fields.values()]), counted), judged)


def checks(named: Mapping[str, tuple[Column, float]]) -> Column:
    """struct(score, failed): the weights of the checks that hold over all weights, and the names of the others, sorted."""
    total = sum(w for _, w in named.values()) or 1.0
    score = sum((F.when(c, float(w)).otherwise(0.0) for c, w in named.values()), F.lit(0.0)) / F.lit(total)
    failed = F.sort_array(F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, (c, _) in named.items()]), lambda x: x.isNotNull()))
    return F.struct(F.round(score, 3).alias("score"), failed.alias("failed"))


def band(score: Column, bands: Sequence[tuple[float, str]], default: str) -> Column:
    """The label of the first limit, from the highest on, that the score reaches."""
    return rules.cascade([(score >= limit, name) for limit, name in sorted(bands, reverse=True)], default)


def decision(fatal: Column, evidence_gap: Column, blockers: Column) -> Column:
    """REJECTED, MORE_EVIDENCE, ADMIN_REVIEW or APPROVED."""
    return rules.cascade([(fatal, "REJECTED"), (evidence_gap, "MORE_EVIDENCE"), (blockers, "ADMIN_REVIEW")], "APPROVED")


def year_in(text: Column) -> Column:
    """The first year from 2000 to 2039 that stands alone, or null."""
    found = F.regexp_extract(text, r"(?<!\d)(20[0-3]\d)(?!\d)", 1)
    return F.when(found != "", found.cast("int"))


def excerpt(text: Column, phrase: str, before: int = 120, after: int = 260) -> Column:
    """The text around a phrase, or its beginning."""
    at = F.instr(F.lower(text), phrase.lower())
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substr(text, start, at + len(phrase) + after - start)).otherwise(F.substring(text, 1, before + after + 40))


def sentences(text: Column, least: int = 24) -> Column:
    """Parts that end with a stop, question or exclamation mark, of `least` characters or more."""
    return F.filter(F.transform(F.split(T.norm(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def emails(text: Column) -> Column:
    """Distinct addresses in lower case, in order; [at] and [dot] are repaired."""
    fixed = F.regexp_replace(F.regexp_replace(F.lower(text), r"\s*[\[(]\s*at\s*[\])]\s*", "@"), r"\s*[\[(]\s*dot\s*[\])]\s*", ".")
    return F.array_distinct(F.regexp_extract_all(fixed, F.lit(r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})"), F.lit(1)))


def abbreviation(text: Column) -> Column:
    """struct(name, short) of "Name (ABC)"; short is empty without one."""
    pattern = r"^(.*\S)\s*\(([A-Z][A-Za-z&-]{1,11})\)\s*$"
    hit = text.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("name"), F.when(hit, F.regexp_extract(text, pattern, 2)).otherwise("").alias("short"))
