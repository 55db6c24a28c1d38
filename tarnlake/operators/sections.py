"""Sections of texts by headings, and the lists that stand in them. Column expressions: no row is taken apart, none shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import once
from .classify import sentences

# fixed values: what a heading line looks like, and what parts the items of a list
HEADING, HEADING_BELOW = r"^[A-Z][A-Za-z /&()-]{2,80}:?$", 90
ITEM_BREAK = r"\s*[•▪●]\s*|\s*;\s*|\s+\d+[.)]\s+"
_ACCENTED, _BARE = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync"


def norm_key(c: Column) -> Column:
    """Lower-case letters a-z and digits alone; letters with the usual Latin accents lose them."""
    return F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _BARE), "[^a-z0-9]+", "")


def lines(text: Column) -> Column:
    """array<string>: a text's lines, white space as single spaces, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r]"), T.norm), lambda x: x != "")


def section_lines(text: Column, aliases: Sequence[str], heading: str = HEADING) -> Column:
    """array<string>: the section that the first line naming an alias begins: that line and all after it, to the next heading line.

    A line names an alias if, by letters and digits, either holds the other; so a line without any names every alias. The line
    right after it belongs to the section whatever it looks like. Empty without such a line, or without a text. Each line is
    looked at once, so long texts cost by their length.
    """
    names = [n for n in (_key(a) for a in aliases) if n]

    def named(line: Column) -> Column:
        def test(key: Column) -> Column:
            out = F.lit(False)
            for n in names:
                out = out | F.contains(key, F.lit(n)) | F.contains(F.lit(n), key)
            return out

        return once(norm_key(line), test)

    def from_first(ls: Column) -> Column:
        first = F.array_position(F.transform(ls, named), True).cast("int")
        return once(F.when(first > 0, F.slice(ls, first, F.size(ls))), to_end)

    def to_end(part: Column) -> Column:
        heads = F.transform(F.slice(part, F.lit(3), F.size(part)), lambda x: (F.length(x) < HEADING_BELOW) & F.rlike(x, F.lit(heading)))
        end = F.array_position(heads, True).cast("int")
        return F.when(end > 0, F.slice(part, F.lit(1), end + 1)).otherwise(part)

    return F.coalesce(once(lines(text), from_first), F.array().cast("array<string>"))


def text_section(text: Column, aliases: Sequence[str], most: int | None = 4000, heading: str = HEADING) -> Column:
    """The lines of section_lines with one space between them; `most` is the rule's cut of the value in characters, None keeps all."""
    out = F.array_join(section_lines(text, aliases, heading), " ")
    return out if most is None else F.substring(out, 1, most)


def _key(alias: str) -> str:
    out = alias.lower().translate(str.maketrans(_ACCENTED, _BARE))
    return "".join(c for c in out if c.isascii() and c.isalnum())


def unique(values: Column) -> Column:
    """array<string>: values with white space as single spaces, without empty ones, the first of those equal but for case. For short lists: each is looked up in all."""
    named = F.transform(values, lambda v: once(T.norm(v), lambda x: F.struct(T.low(x).alias("k"), x.alias("v"))))
    return once(F.filter(named, lambda x: x["k"] != ""), lambda xs: once(F.transform(xs, lambda x: x["k"]), lambda ks: F.transform(F.array_distinct(ks), lambda k: F.get(xs, F.array_position(ks, k).cast("int") - 1)["v"])))


def section_matches(sections: Column, text: Column, terms: Sequence[str], most: int = 12) -> Column:
    """struct<items, method, confidence>: texts (6 characters at least) under headings that hold a term, else sentences (20) that do.

    sections is the map of headings to texts. The first `most` matches count, the same text once. Without any: no items, "none", 0.
    """

    def holds(c: Column) -> Column:
        low = T.low(c)
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(low, F.lit(t.lower()))
        return out

    entries = F.filter(F.coalesce(F.map_entries(sections), F.array().cast("array<struct<key:string,value:array<string>>>")), lambda e: holds(e["key"]))
    under = F.slice(F.filter(F.transform(F.flatten(F.transform(entries, lambda e: e["value"])), T.norm), lambda v: F.length(v) >= 6), 1, most)
    near = F.slice(F.filter(sentences(text, 20), holds), 1, most)

    def told(u: Column) -> Column:
        headed = F.size(u) > 0
        return once(F.when(headed, u).otherwise(near), lambda v: F.struct(unique(v).alias("items"), F.when(headed, "section-heading").when(F.size(v) > 0, "keyword-context").otherwise("none").alias("method"), F.when(headed, 0.9).when(F.size(v) > 0, 0.68).otherwise(0.0).alias("confidence")))

    return once(under, told)


def list_items(values: Column, most: int = 12) -> Column:
    """array<string>: parts between bullets, semicolons and numbers, of 12 to 800 characters, the first `most`, each once."""
    parts = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.split(F.coalesce(v, F.lit("")), ITEM_BREAK)))
    bare = F.transform(parts, lambda p: F.regexp_replace(T.norm(p), "^[ \\-–—:;]+|[ \\-–—:;]+$", ""))
    return unique(F.slice(F.filter(bare, lambda p: F.length(p).between(12, 800)), 1, most))


def clean_texts(values: Column, noise: Column | None = None, least: int = 24) -> Column:
    """array<string>: texts of a list without noise and repeats, in order.

    Texts lose white space and marks at their ends; those of fewer than `least` characters, page counts ("page 1 of 2") and rows
    of a table (three bars) go. Of texts that are equal by letters and digits, and of those of more than 35 where one holds an earlier
    one or is held by it, the first stays. The outcome depends on the order, so it is a fold over the list.
    """
    bare = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_replace(T.norm(v), r"^[ \t\r\n•;:-]+|[ \t\r\n•;:-]+$", ""))
    told = F.filter(bare, lambda v: (F.length(v) >= least) & ~F.rlike(v, F.lit(r"(?i)^page\s+\d+\s+of\s+\d+$")) & (F.length(v) - F.length(F.replace(v, F.lit("|"), F.lit(""))) < 3))
    keyed = F.filter(F.transform(told, lambda v: F.struct(F.trim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", " ")).alias("k"), v.alias("v"))), lambda x: x["k"] != "")

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda y: (y["k"] == x["k"]) | ((F.length(y["k"]) > 35) & (F.length(x["k"]) > 35) & (F.contains(y["k"], x["k"]) | F.contains(x["k"], y["k"]))))
        return F.when(near, acc).otherwise(F.array_append(acc, x))

    return F.transform(F.aggregate(keyed, F.array().cast("array<struct<k:string,v:string>>"), step), lambda x: x["v"])
