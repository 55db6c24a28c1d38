"""Counts, indicators and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from ..storage import store


def counter(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.select(value.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def flattened_counter(df: DataFrame, values: Column, name: str) -> DataFrame:
    """How many times each value occurs in all arrays, without blank ones."""
    return counter(df.select(F.explode(values).alias(name)).where(F.trim(name) != ""), F.col(name), name)


def zero_filled(df: DataFrame, value: Column, name: str, levels: Sequence[str]) -> DataFrame:
    """Counts of all given levels, also those that no row has."""
    dim = df.sparkSession.createDataFrame([(x,) for x in levels], f"{name} string")
    return dim.join(counter(df, value, name), name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def scope_lookup(df: DataFrame, level: str, names: Sequence[str], unspecified: str = "Unspecified") -> DataFrame:
    """(name_key, level): every name that always comes with the same level."""
    rows = df.where(F.col(level) != unspecified).select(level, F.explode(F.array(*[F.lower(F.trim(F.col(n).cast("string"))) for n in names])).alias("name_key"))
    return rows.where("name_key <> ''").groupBy("name_key").agg(F.min(level).alias("level"), F.max(level).alias("__high")).where("level = __high").select("name_key", "level")


def explicit_count(c: Column) -> Column:
    """Distinct values that are not blank."""
    text = F.trim(c.cast("string"))
    return F.count_distinct(F.when(text != "", text))


def funding_summary(df: DataFrame, values: Column) -> DataFrame:
    """One row: rows with and without amounts, least and most amount, exact median of all amounts."""
    own = df.select(F.filter(values, lambda v: v.isNotNull()).alias("v"))
    sizes = own.agg(
        F.count_if(F.size("v") > 0).alias("records_with_funding"), F.count_if(F.size("v") == 0).alias("records_missing_funding"),
        F.min(F.array_min("v")).alias("minimum_recorded_funding"), F.max(F.array_max("v")).alias("maximum_recorded_funding"),
    )
    return sizes.crossJoin(exact_median(own.select(F.explode("v").alias("x")), "x").select(F.col("median").alias("median_recorded_funding")))  # one row each


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """(median): one row, null without values. No task holds more than its range of the distinct values.

    Values are counted and dealt out by ranges; the sums of the ranges tell which one or two hold the middle ranks, and only
    these are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    dealt = store(counts.repartitionByRange("x").withColumn("range", F.spark_partition_id()), "amounts")
    sums = dealt.groupBy("range").agg(F.min("x").alias("low"), F.sum("n").alias("own"))  # a row a range
    upto, total = F.sum("own").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)), F.sum("own").over(Window.partitionBy())
    placed = sums.select("range", (upto - F.col("own")).alias("before"), upto.alias("upto"), F.floor((total - 1) / 2).alias("lower"), F.floor(total / 2).alias("upper"))
    middle = dealt.join(F.broadcast(placed.where("upto > lower AND before <= upper")), "range")
    ranked = middle.withColumn("last", F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("last") > F.col(rank), F.col("x"))).cast("double")
    two = ranked.agg(at("lower").alias("a"), at("upper").alias("b"))
    return two.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b")).alias("median"))


def funding_buckets(df: DataFrame, amount: Column) -> DataFrame:
    return zero_filled(df, money.bucket(amount), "funding_bucket", money.BUCKET_ORDER)


def readiness(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(label, complete, total, percentage): percentages are rounded half to even."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"m{i}") for i, c in enumerate(measures.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"m{i}").alias("complete"), F.col("total").alias("total")) for i, k in enumerate(measures)]))
    share = F.when(F.col("total") == 0, F.lit(0)).otherwise(F.bround(F.col("complete") / F.col("total") * 100, 0))
    return one.select(rows.alias("x")).select("x.label", "x.complete", "x.total").withColumn("percentage", share.cast("int"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """A row for each value of `row`, a count for each of the given values of `column`."""
    return df.where(F.col(row).isNotNull()).groupBy(row).agg(*[F.count_if(F.col(column) == v).cast("long").alias(v.lower()) for v in values])
