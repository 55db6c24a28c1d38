"""Text: blanks, white space, keys, tokens and phrases. All take and return Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as missing, besides white space.
BLANKS = ("none", "nan", "nat", "null")
#: File endings and words of pages that are no part of a name.
FILE_ENDINGS, PAGE_WORDS = ("pdf", "doc", "docx", "xls", "xlsx", "htm", "html", "asp", "aspx", "xml"), ("landing", "official page", "homepage")
#: Words that do not tell one programme from another.
IGNORED_TOKENS = ("and", "the", "for", "of", "under", "scheme", "schemes", "programme", "programmes", "program", "programs", "fund", "funding", "official", "nidhi")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm(c: Column) -> Column:
    """Every run of Unicode white space is one space, none at the ends; null is empty. Single spaces, which are most, are not matched."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), r"(?U)[^\S ]\s*| \s+", " ")), F.lit(""))


def low(c: Column) -> Column:
    """norm, case-folded (sharp s as ss)."""
    return F.replace(F.lower(norm(c)), F.lit("ß"), F.lit("ss"))


def is_blank(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return c.isNull() | (text == "") | F.lower(text).isin(*BLANKS)


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), F.trim(c.cast("string")))


def as_text(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(""))


def first_value(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def as_int(c: Column) -> Column:
    """Whole part of a number with thousands separators, or null."""
    return F.floor(F.abs(_number(c))).cast("long") * F.signum(_number(c)).cast("long")


def _number(c: Column) -> Column:
    return F.replace(blank_to_null(c), F.lit(","), F.lit("")).try_cast("double")


def unquote(c: Column) -> Column:
    """Percent escapes are decoded; a plus stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def clean(c: Column) -> Column:
    return norm(unquote(c.cast("string")))


def split_values(c: Column) -> Column:
    """Parts between semicolons and bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(clean(c), "[;|]"), lambda x: F.trim(x)), lambda x: x != "")


def canonical_key(c: Column) -> Column:
    """Lower case, without file endings and page words, only letters and digits between single spaces."""
    text = F.regexp_replace(low(clean(c)), rf"\.(?:{'|'.join(FILE_ENDINGS)})$", "")
    text = F.regexp_replace(text, rf"\b(?:{'|'.join(PAGE_WORDS)})\b", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def stable_id(prefix: str, *parts: Column) -> Column:
    keys = F.filter(F.array(*[F.when(clean(p) != "", canonical_key(p)) for p in parts]), lambda x: x.isNotNull())
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.array_join(keys, "|"), 256), 1, 20))


def folded_id(prefix: str, *parts: Column) -> Column:
    """The recipe that joins case-folded parts by a unit separator."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.array_join(F.array(*[low(p) for p in parts]), "\x1f"), 256), 1, 20))


def slug(c: Column) -> Column:
    text = F.regexp_replace(F.trim(F.regexp_replace(low(c), "[^a-z0-9]+", " ")), r"\b(?:scheme|programme|program)\b", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", "-"), "^-+|-+$", "")
    return F.when(text == "", F.lit("unresolved")).otherwise(text)


def identity_tokens(c: Column) -> Column:
    """Sorted distinct words that tell names apart; a plural s of words over four letters goes."""
    words = F.filter(F.split(F.lower(as_text(c)), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*IGNORED_TOKENS))
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def phrase_count(c: Column, phrase: str) -> Column:
    """Occurrences of a phrase as whole words in text that is already folded."""
    return F.when(F.contains(c, F.lit(phrase.lower())), F.regexp_count(c, F.lit(rf"(?<!\w){re.escape(phrase.lower())}(?!\w)"))).otherwise(0)


def hits(c: Column, phrases: Iterable[str]) -> Column:
    """The phrases that folded text holds anywhere, in their order."""
    return F.filter(F.array(*[F.when(F.contains(c, F.lit(p)), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())
