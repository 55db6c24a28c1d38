"""Scores by many phrases: one automaton of all vocabularies reads each text once.

Phrases of all classes, and those that veto a class, go into one automaton, which is sent to all tasks: its size is that of
the configuration. A text is read once for each field, whatever the number of phrases; what comes back is the numbers of the
phrases that it holds, and the scores are built-in expressions over these. A phrase is held if the normalised text has it
anywhere; one of up to three letters only as a word of its own. Texts are read in Arrow batches, since built-in functions
read a text once for each phrase.

Null and empty texts hold nothing. A phrase counts once a text, in every class that lists it. Ties go by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as T



def plain(text: str) -> str:
    """As the column `normalised` writes it: in one case, with single blanks."""
    return " ".join(text.split()).casefold()


def normalised(c: Column) -> Column:
    return T.low(c)


class Phrases:
    """Numbers phrases in the order in which they are first given."""

    def __init__(self, *lists: Sequence[str]):
        self.numbers: dict[str, int] = {}
        for phrase in (p for own in lists for p in own):
            if plain(phrase):
                self.numbers.setdefault(plain(phrase), len(self.numbers))

    def of(self, phrases: Sequence[str]) -> list[int]:
        return sorted({self.numbers[plain(p)] for p in phrases if plain(p)})

    def held(self, text: Column) -> Column:
        """The sorted numbers of the phrases that a normalised text holds."""
        words = list(self.numbers)
        made: dict[str, object] = {}

        @F.pandas_udf(ArrayType(IntegerType()))
        def found(texts: pd.Series) -> pd.Series:
            if not made:
                import ahocorasick

                automaton = ahocorasick.Automaton()
                for i, p in enumerate(words):
                    automaton.add_word(p, (i, len(p) if len(p) <= 3 and p.isalpha() else 0))
                automaton.make_automaton()
                made["automaton"] = automaton
            return pd.Series([_read(made["automaton"], t) for t in texts], dtype=object)

        return found(text) if words else F.array().cast("array<int>")


def _read(automaton, text: str | None) -> list[int]:
    found = set()
    for end, (i, whole) in automaton.iter(text or ""):
        if not whole or not (_in_word(text[end + 1 : end + 2]) or end >= whole and _in_word(text[end - whole])):
            found.add(i)
    return sorted(found)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _numbers(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def class_scores(fields: Mapping[str, tuple[Column, float]], classes: Mapping[str, tuple[Sequence[str], Sequence[str]]], phrases: Phrases, *, cap: int = 3) -> Column:
    """array<struct(name, score)>, the best first: over fields of (held, weight), weight times the phrases held, at most `cap`.

    classes: by name, (phrases, phrases that veto the class in a field). Classes without a phrase in any field are left out.
    """
    table = F.array(*[F.struct(F.lit(name).alias("name"), _numbers(phrases.of(own)).alias("own"), _numbers(phrases.of(veto)).alias("veto")) for name, (own, veto) in classes.items()])

    def score(c: Column) -> Column:
        each = [F.when(F.arrays_overlap(held, c["veto"]), 0.0).otherwise(F.lit(float(weight)) * F.least(F.lit(cap), F.size(F.array_intersect(held, c["own"])))) for held, weight in fields.values()]
        return sum(each[1:], each[0])

    scored = F.transform(table, lambda c: F.struct((-score(c)).alias("minus"), c["name"].alias("name")))
    return F.transform(F.array_sort(F.filter(scored, lambda c: c["minus"] < 0)), lambda c: F.struct(c["name"].alias("name"), (-c["minus"]).alias("score")))


def others(scores: Column, label: Column, *, least: float, ratio: float, most: int) -> Column:
    """The names of up to `most` further classes with `least` and with the best one's score times the ratio, at least."""
    bound = F.greatest(F.lit(float(least)), F.coalesce(F.get(scores, F.lit(0))["score"], F.lit(0.0)) * ratio)
    return F.slice(F.transform(F.filter(scores, lambda c: (c["name"] != label) & (c["score"] >= bound)), lambda c: c["name"]), 1, most)


def decision(scores: Column, *, least: float, margin: float, default: str) -> Column:
    """struct(label, score, runner_up, lead, flag): the best class if it has `least`; flags: none, weak, close."""
    best, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    top, lead = F.coalesce(best["score"], F.lit(0.0)), F.coalesce(best["score"], F.lit(0.0)) - F.coalesce(second["score"], F.lit(0.0))
    flag = F.when(top == 0, "NO_EVIDENCE").when(top < least, "WEAK_EVIDENCE").when(lead < margin, "CLOSE_RUNNER_UP").otherwise("")
    return F.struct(F.when(top >= least, best["name"]).otherwise(default).alias("label"), top.alias("score"), F.coalesce(second["name"], F.lit("")).alias("runner_up"), lead.alias("lead"), flag.alias("flag"))


def dictionary_score(held: Column, vocabulary: Mapping[str, float], phrases: Phrases) -> Column:
    """struct(score, matched): the sum of the weights of the phrases held, and these in the order of the vocabulary."""
    rows = F.array(*[F.struct(F.lit(phrases.of([p])[0]).alias("i"), F.lit(p).alias("p"), F.lit(float(w)).alias("w")) for p, w in vocabulary.items() if plain(p)])
    own = F.filter(rows, lambda r: F.array_contains(held, r["i"]))
    return F.struct(F.aggregate(own, F.lit(0.0), lambda s, r: s + r["w"]).alias("score"), F.transform(own, lambda r: r["p"]).alias("matched"))


def contained(text: Column, phrase: str) -> Column:
    """Whether a normalised text holds one phrase: what the automaton tells, phrase by phrase."""
    p = plain(phrase)
    if not p:
        return F.lit(False)
    return text.rlike(rf"(?U)(?<!\w){p}(?!\w)") if len(p) <= 3 and p.isalpha() else F.contains(text, F.lit(p))
