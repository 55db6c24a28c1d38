"""Amounts of money in rupees. All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much a unit is.
UNITS = {"thousand": 1_000, "k": 1_000, "lakh": 100_000, "lac": 100_000, "lakhs": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000, "million": 1_000_000, "mn": 1_000_000}
#: The highest amount of each class.
BUCKETS = (("up_to_10_lakh", 1_000_000), ("10_lakh_to_1_crore", 10_000_000), ("1_crore_to_10_crore", 100_000_000), ("10_crore_to_50_crore", 500_000_000))
OPEN_BUCKET, NO_BUCKET = "above_50_crore", "not_specified"
BUCKET_ORDER = (*(name for name, _ in BUCKETS), OPEN_BUCKET, NO_BUCKET)
#: A number and the longest unit that follows it.
_PATTERN = rf"(\d+(?:\.\d+)?)\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})?"


def parse_amount(c: Column) -> Column:
    """The first number with its unit, else the whole text as a positive number, else null. The unit has no right edge."""
    text = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(""))
    folded = F.lower(text)
    number, unit = F.regexp_extract(folded, _PATTERN, 1), F.regexp_extract(folded, _PATTERN, 2)
    times = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    plain = text.try_cast("decimal(30,6)")
    with_unit = F.floor(number.try_cast("decimal(24,6)") * times[unit]).cast("long")
    return F.when(text.isNull() | folded.isin("", "none", "nan", "null"), F.lit(None).cast("long")).when(unit != "", with_unit).when(plain > 0, F.floor(plain).cast("long"))


def bucket(amount: Column) -> Column:
    out = F.when(amount.isNull(), F.lit(NO_BUCKET))
    for name, most in BUCKETS:
        out = out.when(amount <= most, F.lit(name))
    return out.otherwise(F.lit(OPEN_BUCKET))


def format_inr(amount: Column) -> Column:
    return F.when(amount.isNull(), F.lit("Not recorded")).when(amount >= 10_000_000, F.concat(F.lit("Rs "), F.format_number(amount / 10_000_000, 2), F.lit(" Cr"))).when(amount >= 100_000, F.concat(F.lit("Rs "), F.format_number(amount / 100_000, 2), F.lit(" Lakh"))).otherwise(F.concat(F.lit("Rs "), F.format_number(amount, 0)))


def within(values: Column, least: int | None, most: int | None) -> Column:
    """Some amount can be within the limits; without limits everything is."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (F.array_max(values) >= least)
    if most is not None:
        ok = ok & (F.array_min(values) <= most)
    return F.coalesce(ok, F.lit(False))
