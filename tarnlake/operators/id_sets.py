"""Counts of many overlapping sets of ids, and of many dimensions, from one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def overlaps(df: DataFrame, ident: str, sets: Mapping[str, Column]) -> DataFrame:
    """(left, right, n): distinct ids in both of two sets, for each pair in the sets' order; a set with itself gives its size.

    An id is in a set if any of its rows meets the condition; a condition that is null is not met. Rows without an id do not
    count. Each id becomes one mask of bits by a partial `bit_or`, masks are counted, and pairs read off at most
    2 ** len(sets) masks, so that neither copies of an id nor frequent ids meet anywhere. At most 60 sets.
    """
    if not 0 < len(sets) <= 60:
        raise ValueError("1 to 60 sets")
    names = list(sets)
    bits = F.lit(0).cast("long")
    for i, cond in enumerate(sets.values()):
        bits = bits.bitwiseOR(F.when(cond, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    masks = df.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("__id")).agg(F.bit_or(bits).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    pairs = [(a, b) for i, a in enumerate(range(len(names))) for b in range(i, len(names))]
    listed = F.array(*[F.struct(F.lit(names[a]).alias("left"), F.lit(names[b]).alias("right"), F.lit((1 << a) | (1 << b)).cast("long").alias("bits")) for a, b in pairs])
    # every mask gives every pair, with 0 where it has not both: pairs without an id stay
    rows = masks.select("mask", "n", F.explode(listed).alias("p"))
    return rows.groupBy("p.left", "p.right").agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("p.bits")) == F.col("p.bits"), F.col("n")).otherwise(0)).alias("n"))


def counters(df: DataFrame, dimensions: Mapping[str, Column], declared: Mapping[str, Sequence[str]] | None = None, missing: str = "UNKNOWN") -> DataFrame:
    """(dimension, value, n, position): rows by the values of each dimension, all from one scan by grouping sets.

    Blank values count under `missing`. Declared values come first, in their order, with 0 where no row has them; the others
    follow by falling count, then by value. positions are numbered from 1 within a dimension.
    """
    spark, names, declared = df.sparkSession, list(dimensions), dict(declared or {})
    text = df.select(*[F.coalesce(T.blank_to_null(c), F.lit(missing)).alias(n) for n, c in dimensions.items()])
    counted = text.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, n in enumerate(names):
        own = F.col("g") == ((1 << len(names)) - 1 - (1 << (len(names) - 1 - i)))
        which, value = F.when(own, n).otherwise(which), F.when(own, F.col(n)).otherwise(value)
    found = counted.select(which.alias("dimension"), value.alias("value"), "n", F.lit(None).cast("int").alias("place"))
    zero = spark.createDataFrame([(d, v, 0, i) for d, vs in declared.items() for i, v in enumerate(vs)], "dimension string, value string, n long, place int")
    merged = found.unionByName(zero).groupBy("dimension", "value").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    # one list a dimension: the distinct values of what is counted for a report
    ordered = merged.groupBy("dimension").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(2**31 - 1)).alias("place"), (-F.col("n")).alias("m"), "value"))).alias("vs"))
    return ordered.select("dimension", F.posexplode("vs").alias("p", "v")).select("dimension", "v.value", (-F.col("v.m")).alias("n"), (F.col("p") + 1).alias("position"))


def options(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """(field, option, position): the distinct values of each field that are not blank, in the order of their lower case.

    Fields are texts or arrays of texts. All come from one scan.
    """

    def named(name: str, c: Column) -> Column:
        values = c if df.select(c).schema[0].dataType.typeName() == "array" else F.array(c)
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), F.trim(v.cast("string")).alias("option")))

    arrays = [named(name, c) for name, c in fields.items()]
    rows = df.select(F.explode(F.concat(*[F.coalesce(a, F.array().cast("array<struct<field:string,option:string>>")) for a in arrays])).alias("x")).select("x.field", "x.option")
    distinct = rows.where("option <> ''").distinct()
    listed = distinct.groupBy("field").agg(F.array_sort(F.collect_list(F.struct(T.low(F.col("option")).alias("k"), "option"))).alias("xs"))
    return listed.select("field", F.posexplode("xs").alias("p", "x")).select("field", "x.option", (F.col("p") + 1).alias("position"))
