"""Dates in texts. All take and return Columns; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm, once

#: Names of months, and their short forms.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _month_numbers() -> Column:
    numbers = {name: i for names in (MONTHS, SHORT_MONTHS) for i, name in enumerate(names, 1)} | {"sept": 9}
    return F.create_map(*[F.lit(x) for kv in numbers.items() for x in (kv[0], str(kv[1]))])


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def iso_prefix(c: Column) -> Column:
    """The first ten characters as a strict ISO date."""
    text = F.substring(F.trim(c.cast("string")), 1, 10)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def call_date(c: Column) -> Column:
    """dd/mm/yyyy, yyyy-mm-dd or dd-mm-yyyy."""
    text = F.trim(c.cast("string"))
    day_first = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    return F.when(text.rlike(day_first) & ~text.rlike(r"^\d+/\d+-|^\d+-\d+/"), _made(*(F.regexp_extract(text, day_first, g) for g in (3, 2, 1)))).when(text.rlike(iso), _made(*(F.regexp_extract(text, iso, g) for g in (1, 2, 3))))


def _each_place(words: Column, read) -> Column:
    """read(place) for each place of an array."""
    return F.transform(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), read)


def _dated(y: Column, m: Column, d: Column) -> Column:
    return F.when(y.rlike(r"^20\d\d$") & m.isNotNull() & (d != ""), _made(y, m, d))


def _named_dates(words: Column) -> Column:
    """Of an array of words and marks: day month year and month day year, a comma before the year or none."""
    number = _month_numbers()

    def read(i: Column) -> Column:
        first, second, third = F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)
        year = F.when(third == ",", F.get(words, i + 3)).otherwise(third)
        day = lambda w: F.regexp_extract(w, r"^(\d{1,2})(?:st|nd|rd|th)?$", 1)
        return F.when(number[second].isNotNull(), _dated(year, number[second], day(first))).when(number[first].isNotNull(), _dated(year, number[first], day(second)))

    return _each_place(words, read)


def _number_dates(run: Column) -> Column:
    """Of numbers between full stops, slashes or hyphens: day, month and year that stand in a row."""
    short = lambda w: F.regexp_extract(w, r"^(\d{1,2})$", 1)

    def read(parts: Column) -> Column:
        return _each_place(parts, lambda i: F.when(short(F.get(parts, i + 1)) != "", _dated(F.get(parts, i + 2), short(F.get(parts, i + 1)), short(F.get(parts, i)))))

    return once(F.split(run, "[./-]"), read)


def extract(c: Column) -> Column:
    """All dates in a text, sorted and distinct: day month year, month day year, and numbers, of the years 2000 to 2099.

    The text is cut into words and marks, which are read with their neighbours. Days may end in st, nd, rd or th; a comma may
    stand before the year, which may be joined to the month. Numbers are parted by full stops, slashes or hyphens.
    """

    def read(text: Column) -> Column:
        joined = lambda w: F.regexp_extract(w, r"^([a-z]+)20\d\d$", 1)
        words = F.regexp_extract_all(text, F.lit(r"(\w+|[^\s\w])"), F.lit(1))
        words = F.flatten(F.transform(words, lambda w: F.when(_month_numbers()[joined(w)].isNotNull(), F.array(joined(w), F.right(w, F.lit(4)))).otherwise(F.array(w))))
        runs = F.regexp_extract_all(text, F.lit(r"(?<!\w)(\d+(?:[./-]\d+)+)(?!\w)"), F.lit(1))
        return F.concat(once(words, _named_dates), F.flatten(F.transform(runs, _number_dates)))

    return F.sort_array(F.array_distinct(F.filter(once(F.lower(norm(c)), read), lambda d: d.isNotNull())))
