"""Ordered rules and weighted phrases, as single expressions that stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def cascade(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; a rule whose condition is null does not."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(default) if out is None else out.otherwise(default)


def cascade_with_reason(rules: Sequence[tuple[Column, str, float, str]], default: tuple[str, float, str]) -> Column:
    """struct(label, confidence, reason) of the first rule that holds."""
    def made(label, confidence, reason):
        return F.struct(F.lit(label).alias("label"), F.lit(float(confidence)).alias("confidence"), F.lit(reason).alias("reason"))

    out = None
    for condition, *rest in rules:
        out = F.when(condition, made(*rest)) if out is None else out.when(condition, made(*rest))
    return made(*default) if out is None else out.otherwise(made(*default))


def first_containing(text: Column, labels: Mapping[str, str], default: str) -> Column:
    """The label of the first key, in order, that the text holds."""
    return cascade([(F.contains(text, F.lit(k)), v) for k, v in labels.items()], default)


def keyword_score(text: Column, weights: Mapping[str, int], low: int = 0, high: int = 100) -> Column:
    """The sum of the weights of the keywords that the text holds, kept within limits."""
    total = F.lit(0)
    for k, w in weights.items():
        total = total + F.when(F.contains(text, F.lit(k)), w).otherwise(0)
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def sector_scores(text: Column, sectors: Sequence[Mapping]) -> Column:
    """array<struct<sector, score>> by score descending, then name: strong phrases give 8 each up to 3 times, weak 2 up
    to 3 times, negative take 5 up to 2 times. text is folded already."""

    def total(t: Column, s: Mapping) -> Column:
        out = F.lit(0)
        for name, weight, most in (("strong", 8, 3), ("weak", 2, 3), ("negative", -5, 2)):
            for p in s.get(name, ()):
                out = out + F.least(T.phrase_count(t, p), F.lit(most)) * weight
        return out

    scored = T.once(text, lambda t: F.array(*[F.struct((-total(t, s)).cast("int").alias("minus"), F.lit(s["sector"]).alias("sector")) for s in sectors]))
    return F.transform(F.sort_array(scored), lambda x: F.struct(x["sector"].alias("sector"), (-x["minus"]).alias("score")))


def relevance(text: Column, beneficiaries: Sequence[str], access: Sequence[str], institution_only: Sequence[str]) -> Column:
    """struct(classification, score, publishable) of folded text."""

    def told(n: Column) -> Column:
        score = F.greatest(F.lit(0), F.least(F.lit(100), F.least(F.lit(60), n["b"] * 30) + F.least(F.lit(40), n["a"] * 10) - n["n"] * 35))
        cases = [((n["n"] > 0) & (n["b"] == 0), "RESEARCH_OR_INSTITUTION_ONLY"), ((n["b"] > 0) & (n["a"] > 0), "DIRECT_OR_MEDIATED_STARTUP_SUPPORT"), (n["b"] > 0, "STARTUP_ECOSYSTEM_REFERENCE")]
        label = cascade(cases, "RELEVANCE_REVIEW_REQUIRED")
        return F.struct(label.alias("classification"), score.alias("score"), ((score >= 70) & (label == "DIRECT_OR_MEDIATED_STARTUP_SUPPORT")).alias("publishable"))

    counts = T.once(text, lambda t: F.struct(*[F.size(T.hits(t, phrases)).alias(x) for phrases, x in ((beneficiaries, "b"), (access, "a"), (institution_only, "n"))]))
    return T.once(counts, told)
