"""JSON of any depth: its nodes, the first value under a name, its leaves, and the merge of two objects.

A text is opened level by level. A frontier of rows holds the objects and arrays that are not opened yet; one job opens several
levels within the row and stores them, and the next starts from what is left, until nothing is. So neither depth nor the size
of a table is bounded, and a row with a deep text does not hold back the others. Keys keep their order: a map of texts tells
keys and texts in order, a map of VARIANT beside it tells the kinds.

Texts that are no JSON have no nodes; an object that repeats a key further down counts as none. Numbers are written as Spark
writes them. Rows of one id are told apart by their texts alone: give rows ids of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import store

_OBJECT, _ARRAY = "map<string,variant>", "array<variant>"
_NODE = "array<struct<path:array<int>,key:string,text:string,kind:string>>"


def _kind(v: Column) -> Column:
    """object, array, string, null or scalar."""
    told = F.when(v.isNull() | F.is_variant_null(v), "null").when(F.try_variant_get(v, "$", _OBJECT).isNotNull(), "object").when(F.try_variant_get(v, "$", _ARRAY).isNotNull(), "array")
    return told.when(F.schema_of_variant(v) == "STRING", "string").otherwise("scalar")


def _children(text: Column, kind: Column, path: Column, levels: int) -> Column:
    """The nodes below a node, as many levels as told."""
    own = lambda key, value, v, i: F.struct(F.concat(path, F.array(i)).alias("path"), key.alias("key"), value.alias("text"), _kind(v).alias("kind"))
    entries = F.zip_with(F.map_entries(F.from_json(text, "map<string,string>")), F.map_values(F.from_json(text, _OBJECT)), lambda e, v: F.struct(e.alias("e"), v.alias("v")))
    items = F.zip_with(F.from_json(text, "array<string>"), F.from_json(text, _ARRAY), lambda e, v: F.struct(e.alias("e"), v.alias("v")))
    none = F.lit(None).cast("string")
    of_object = F.transform(entries, lambda x, i: own(x["e"]["key"], x["e"]["value"], x["v"], i))
    of_array = F.transform(items, lambda x, i: own(none, x["e"], x["v"], i))
    made = F.coalesce(F.when(kind == "object", of_object).when(kind == "array", of_array), F.array().cast(_NODE))
    if levels == 1:
        return made
    return F.flatten(F.transform(made, lambda c: F.concat(F.array(c), _children(c["text"], c["kind"], c["path"], levels - 1))))


def nodes(rows: DataFrame, key: str, json: str, levels: int = 5) -> DataFrame:
    """(key, path, name, text, kind) of every node; the root has an empty path. Paths in order are the order of reading.

    path: places among brothers, from the root; name: the key, null in arrays; text: of containers JSON, of strings themselves.
    """
    root = rows.select(F.col(key), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"), F.col(json).alias("text"), F.try_parse_json(F.col(json)).alias("v"))
    root = root.where("v IS NOT NULL").withColumn("kind", _kind(F.col("v"))).withColumn("text", F.when(F.col("kind").isin("object", "array"), F.col("text")).otherwise(F.try_variant_get("v", "$", "string"))).drop("v")
    every = open_ = store(root, "json-nodes")
    at = 0
    while not (open_ := open_.where((F.size("path") == at) & F.col("kind").isin("object", "array"))).isEmpty():
        found = open_.select(key, F.explode(_children(F.col("text"), F.col("kind"), F.col("path"), levels)).alias("x")).select(key, "x.path", F.col("x.key").alias("name"), "x.text", "x.kind")
        open_ = store(found, "json-nodes")
        every, at = every.unionByName(open_), at + levels
    return every


def deep_find(rows: DataFrame, key: str, json: str, wanted: Sequence[str]) -> DataFrame:
    """(key, found) of every key with a node: the first value under one of the names, in any case, that is not blank.

    All names of an object are looked at before what stands in it is.
    """
    hit = F.lower("name").isin([w.lower() for w in wanted]) & (F.col("kind").isin("object", "array") | (F.col("kind") != "null") & ~T.is_blank(F.col("text")))
    place = F.struct(F.slice("path", 1, F.size("path") - 1).alias("of"), F.element_at("path", -1).alias("at"))
    return nodes(rows, key, json).groupBy(key).agg(F.min_by("text", F.when(hit & (F.size("path") > 0), place)).alias("found"))


def leaves(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, text): leaves that say something, with white space as single blanks; zeros and false do not."""
    told = F.when((F.col("kind") == "scalar") & (F.col("text") == "true"), "True").when((F.col("kind") == "scalar") & F.col("text").rlike("^(false|-?0(\\.0+)?)$"), "").otherwise(F.col("text"))
    own = nodes(rows, key, json).where("kind IN ('string', 'scalar')").select(key, "path", F.regexp_replace(F.regexp_replace(told, r"^\s+|\s+$", ""), r"\s+", " ").alias("text"))
    return own.where("text <> ''")


def _quoted(c: Column) -> Column:
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _encoded(text: Column, kind: Column) -> Column:
    return F.when(kind == "string", _quoted(text)).when(kind == "null", "null").otherwise(text)


def merge(rows: DataFrame, key: str, base: str, incoming: str) -> DataFrame:
    """(key, merged): the base with what it lacks or has blank from the incoming object, and so on within objects of both.

    Keys of the base come first. A base or an incoming text that is no object leaves the base as it is.
    """
    levels = []
    open_ = rows.select(F.col(key), F.array().cast("array<int>").alias("path"), F.col(base).alias("b"), F.col(incoming).alias("c"))
    kinds = [_kind(F.try_parse_json(F.col(c))) for c in ("b", "c")]
    goes_on = (kinds[0] == "object") & (kinds[1] == "object") & (F.size(F.from_json("c", _OBJECT)) > 0)
    told = store(open_.withColumn("on", F.coalesce(goes_on, F.lit(False))), "json-merge")
    alone, open_ = told.where("NOT on").select(key, F.col("b").alias("merged")), told.where("on").drop("on")
    while not open_.isEmpty():
        maps = open_.select(key, "path", *(F.from_json(c, t).alias(n) for c, n, t in (("b", "bs", "map<string,string>"), ("b", "bv", _OBJECT), ("c", "cs", "map<string,string>"), ("c", "cv", _OBJECT))))
        names = F.concat(F.map_keys("bs"), F.array_except(F.map_keys("cs"), F.map_keys("bs")))
        each = maps.select(key, "path", "bs", "bv", "cs", "cv", F.posexplode(names).alias("i", "name"))
        each = each.select(key, F.concat("path", F.array("i")).alias("path"), "name", *(F.map_contains_key(m, F.col("name")).alias(n) for m, n in (("bs", "has"), ("cs", "has_c"))), *(F.try_element_at(m, F.col("name")).alias(n) for m, n in (("bs", "b"), ("bv", "bv"), ("cs", "c"), ("cv", "cv"))))
        each = each.withColumn("bk", _kind(F.col("bv"))).withColumn("ck", _kind(F.col("cv"))).drop("bv", "cv")
        blank = ~F.col("has") | (F.col("bk") == "null") | ~F.col("bk").isin("object", "array") & T.is_blank(F.col("b"))
        both = F.col("has") & F.col("has_c") & (F.col("bk") == "object") & (F.col("ck") == "object")
        json = F.when(~both, F.when(blank & F.col("has_c"), _encoded(F.col("c"), F.col("ck"))).otherwise(_encoded(F.col("b"), F.col("bk"))))
        levels.append(store(each.select(key, "path", "name", "b", "c", json.alias("json")), "json-merge"))
        open_ = levels[-1].where("json IS NULL").select(key, "path", "b", "c")
    above = None
    for found in reversed(levels):  # an object's text is made of those of its members
        done = found.where("json IS NOT NULL").select(key, "path", "name", "json")
        if above is not None:
            done = done.unionByName(found.where("json IS NULL").select(key, "path", "name").join(above, [key, "path"], "left").select(key, "path", "name", F.coalesce("json", F.lit("{}")).alias("json")))
        members = done.select(key, F.slice("path", 1, F.size("path") - 1).alias("path"), F.element_at("path", -1).alias("i"), F.concat(_quoted(F.col("name")), F.lit(":"), "json").alias("m"))
        made = members.groupBy(key, "path").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms"))
        above = store(made.select(key, "path", F.concat(F.lit("{"), F.array_join(F.col("ms")["m"], ","), F.lit("}")).alias("json")), "json-merge")
    if above is None:
        return alone
    return alone.unionByName(above.select(key, F.col("json").alias("merged")))
