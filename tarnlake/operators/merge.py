"""Upserts, differences, guards and state transitions on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_hash(columns: Sequence[str]) -> Column:
    """A digest of values in order; null differs from empty."""
    return F.sha2(F.array_join(F.transform(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("~"))), "\x1f"), 256)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], *, preserve: Sequence[str] = ()) -> DataFrame:
    """Rows of delta replace those of their key, but for the preserved columns; the others stay."""
    b, d = base.withColumn("__b", F.lit(True)).alias("b"), delta.withColumn("__d", F.lit(True)).alias("d")
    joined = b.join(d, [F.col(f"b.{k}") == F.col(f"d.{k}") for k in keys], "full")
    new = F.col("d.__d").isNotNull()

    def pick(c: str) -> Column:
        if c in preserve:
            return F.when(F.col("b.__b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"d.{c}"))
        return F.when(new, F.col(f"d.{c}")).otherwise(F.col(f"b.{c}"))

    return joined.select(*[pick(c).alias(c) for c in base.columns])


def insert_ignore(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.unionByName(delta.join(base.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys)))


def compare(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change): ADDED, REMOVED, CHANGED or UNCHANGED."""
    o, n = old.select(key, record_hash(columns).alias("old_hash")), new.select(key, record_hash(columns).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "ADDED").when(F.col("new_hash").isNull(), "REMOVED").when(F.col("old_hash") != F.col("new_hash"), "CHANGED").otherwise("UNCHANGED")
    return o.join(n, key, "full").select(key, change.alias("change"))


def change_guard(changes: DataFrame, most_percent: float) -> DataFrame:
    """One row: counts of changes, their share of the old rows in percent, and whether that is allowed."""
    one = changes.agg(*[F.count_if(F.col("change") == c).alias(c.lower()) for c in ("ADDED", "REMOVED", "CHANGED", "UNCHANGED")])
    old = F.col("removed") + F.col("changed") + F.col("unchanged")
    share = F.when(old == 0, F.lit(100.0)).otherwise(F.round((F.col("added") + F.col("removed") + F.col("changed")) * 100.0 / old, 4))
    return one.withColumn("change_percent", share.cast("double")).withColumn("allowed", F.col("change_percent") <= most_percent)


def reuse(base: DataFrame, current: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, action): current rows whose fingerprint base has are REUSED, others PROCESSED; of base alone RETIRED."""
    change = compare(base, current, key, columns)
    return change.select(key, F.when(F.col("change") == "UNCHANGED", "REUSED").when(F.col("change") == "REMOVED", "RETIRED").otherwise("PROCESSED").alias("action"))


def overlap(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, tables): keys that more than one table has, with the tables' names in order."""
    out = None
    for name, df in tables.items():
        own = df.select(key, F.lit(name).alias("name")).distinct()
        out = own if out is None else out.unionByName(own)
    return out.groupBy(key).agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") > 1).select(key, F.array_join("names", ",").alias("tables"))


def transition(df: DataFrame, state: Column, action: Column, allowed: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds next_state and is_allowed by a table of (state, action, next state); what it lacks stays as it is."""
    dim = df.sparkSession.createDataFrame(list(allowed), "__s string, __a string, next_state string")
    joined = df.withColumn("__state", state).withColumn("__action", action).join(F.broadcast(dim), (F.col("__state") == F.col("__s")) & (F.col("__action") == F.col("__a")), "left")
    return joined.withColumn("is_allowed", F.col("next_state").isNotNull()).withColumn("next_state", F.coalesce("next_state", "__state")).drop("__s", "__a", "__state", "__action")
