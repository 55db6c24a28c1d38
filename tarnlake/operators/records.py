"""Building of records from tables: list cells, attributes by group, contacts, addresses, sectors and support types.

Columns in, Columns out, but where rows of one id are gathered; there, repeats are removed by a partial aggregate first, so
that what is collected for an id is its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import populations

#: The keys of an object that tell its text, in order, and an address in a text.
TEXT_KEYS = ("value", "name", "title", "label", "description", "text", "url")
URL = r"(?i)https?://[^\s\"'<>\]\)]+"


def _plain(c: Column) -> Column:
    """Text without blanks, hyphens, asterisks and tabs at its ends; blank values are empty."""
    return F.regexp_replace(T.as_text(c), r"^[ *\t-]+|[ *\t-]+$", "")


def _key(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def distinct_texts(items: Column) -> Column:
    """The texts of an array that are not blank, the first of those that differ in case alone."""
    texts = F.filter(F.transform(items, _plain), lambda x: x != "")
    one = F.transform(F.array(texts), lambda ts: F.transform(F.array(F.transform(ts, _key)), lambda ks: F.filter(ts, lambda x, i: F.array_position(ks, _key(x)) == i + 1))[0])[0]
    return F.coalesce(one, F.array().cast("array<string>"))


def item_text(c: Column) -> Column:
    """A JSON object's first of TEXT_KEYS that is not blank, else its "key: value" pairs; other texts are themselves."""
    m = F.from_json(c, "map<string,string>")
    told = F.coalesce(*[T.blank_to_null(F.element_at(m, F.lit(k))) for k in TEXT_KEYS])
    pairs = F.array_join(F.transform(F.filter(F.map_entries(m), lambda e: ~T.is_blank(e["value"])), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return F.when(F.trim(c).startswith("{") & m.isNotNull(), F.coalesce(told, pairs)).otherwise(c)


def to_list(c: Column) -> Column:
    """A cell's values: of a JSON list (in either quotes) or object, or between bars, semicolons and line ends."""
    text = T.as_text(c)
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return distinct_texts(F.when(listed.isNotNull(), F.transform(listed, item_text)).when(text.startswith("{"), F.array(item_text(text))).otherwise(F.split(text, r"\s*[|;\n]\s*")))


def parts(c: Column) -> Column:
    """A cell's parts between semicolons and bars, trimmed, without empty ones; repeats stay."""
    return F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), "[;|]"), lambda x: F.trim(x)), lambda x: x != "")


def merge_reasons(*lists: Column) -> Column:
    """The distinct texts of several arrays in order; null arrays are empty."""
    both = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != ""))


def _gathered(rows: DataFrame, by: Sequence[str], value: str, ordinal: str) -> DataFrame:
    """(by, values): distinct values of each group by their first place; `value` is blank nowhere."""
    firsts = rows.withColumn("__text", _plain(F.col(value))).where("__text <> ''").groupBy(*by, _key(F.col("__text")).alias("__key")).agg(F.min(F.struct(F.col(ordinal), F.col("__text"))).alias("__x"))
    return firsts.groupBy(*by).agg(F.sort_array(F.collect_list("__x")).alias("__x")).select(*by, F.transform("__x", lambda x: x["__text"]).alias("values"))


def attributes(df: DataFrame, ident: str, group: str, value: str, ordinal: str) -> DataFrame:
    """(ident, attributes): a map of group, in lower case, to its distinct values in order. Rows with a blank in any are left out."""
    rows = df.select(T.as_text(F.col(ident)).alias("__id"), _key(T.as_text(F.col(group))).alias("__group"), T.as_text(F.col(value)).alias("__value"), F.col(ordinal).alias("__at")).where("__id <> '' AND __group <> '' AND __value <> ''")
    lists = _gathered(rows, ["__id", "__group"], "__value", "__at")
    return lists.groupBy(F.col("__id").alias(ident)).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__group", "values")))).alias("attributes"))


def values_for(attributes_map: Column, groups: Sequence[str]) -> Column:
    """The distinct values of some groups, by name of group."""
    wanted = sorted({g.lower() for g in groups})
    return distinct_texts(F.flatten(F.map_values(F.map_filter(attributes_map, lambda k, _: k.isin(*wanted)))))


def contacts(df: DataFrame, ident: str, kind: str, contact: str, ordinal: str) -> DataFrame:
    """(ident, contacts): distinct "type: value" texts of each id in order; the type may be blank, the value not."""
    label = F.when(T.as_text(F.col(kind)) != "", F.concat(T.as_text(F.col(kind)), F.lit(": "), T.as_text(F.col(contact)))).otherwise(T.as_text(F.col(contact)))
    rows = df.where((T.as_text(F.col(ident)) != "") & (T.as_text(F.col(contact)) != "")).select(T.as_text(F.col(ident)).alias("__id"), label.alias("__label"), F.col(ordinal).alias("__at"))
    return _gathered(rows, ["__id"], "__label", "__at").select(F.col("__id").alias(ident), F.col("values").alias("contacts"))


def urls(c: Column) -> Column:
    """The distinct addresses in a text, without stops and commas at their ends."""
    found = F.regexp_extract_all(T.as_text(c), F.lit(f"({URL})"), F.lit(1))
    return distinct_texts(F.transform(found, lambda u: F.regexp_replace(u, "[.,;]+$", "")))


def safe_url(c: Column) -> Column:
    """The first address in a text, or an empty one."""
    return F.regexp_replace(F.regexp_extract(T.as_text(c), f"({URL})", 1), "[.,;]+$", "")


def source_urls(df: DataFrame, ident: str, columns: Sequence[str], ordinal: str) -> DataFrame:
    """(ident, urls): the distinct addresses in some columns of an id's rows, in order of rows, columns and places."""
    cells = df.where(T.as_text(F.col(ident)) != "").select(T.as_text(F.col(ident)).alias("__id"), F.col(ordinal).alias("__row"), F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("__column", "__cell"))
    rows = cells.select("__id", "__row", "__column", F.posexplode(urls(F.col("__cell"))).alias("__place", "__url")).select("__id", "__url", F.struct("__row", "__column", "__place").alias("__at"))
    return _gathered(rows, ["__id"], "__url", "__at").select(F.col("__id").alias(ident), F.col("values").alias("urls"))


def last_rows(df: DataFrame, ident: str, ordinal: str) -> DataFrame:
    """The last row of each id; rows without one are left out."""
    rows = df.where(T.as_text(F.col(ident)) != "")
    return rows.groupBy(T.as_text(F.col(ident)).alias("__id")).agg(F.max_by(F.struct(*df.columns), F.col(ordinal)).alias("__x")).select("__x.*")


def primary_sector(sectors: Column, sector: Column) -> Column:
    """The first of the sectors, or of the single sector, in the catalogue's terms."""
    return populations.sector(F.coalesce(F.get(parts(sectors), F.lit(0)), F.get(parts(sector), F.lit(0)), F.lit("")))


def secondary_sectors(sectors: Column, sector: Column) -> Column:
    """The others, in the catalogue's terms."""
    own = F.when(F.size(parts(sectors)) > 0, parts(sectors)).otherwise(parts(sector))
    return F.transform(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), populations.sector)


def primary_support_type(types: Column, kind: Column) -> Column:
    """The support type of the first type given, or else of the kind of record."""
    return populations.support_type(F.coalesce(F.get(parts(types), F.lit(0)), T.blank_to_null(kind), F.lit("SCHEME_OR_PROGRAMME")))


def secondary_support_types(types: Column) -> Column:
    return F.transform(F.slice(parts(types), F.lit(2), F.greatest(F.size(parts(types)), F.lit(1))), populations.support_type)
