"""Keyed deduplication. Every operator takes an order, so results do not depend on how rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def best_value(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """best_by for the highest rank, as a partial aggregate: a hot key is one row a task before it is dealt out."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*rank))
    return df.groupBy(*keys).agg(best.alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, key: str, ordinal: str, *, keep_blank: bool = False) -> DataFrame:
    """The first row of each key; rows of a blank key all go, or all stay."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    kept = best_by(df.where(~blank), [key], [F.col(ordinal).asc()])
    return kept.unionByName(df.where(blank)) if keep_blank else kept


def last_value_first_place(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key at the place of its first: an update keeps its position."""
    rest = [c for c in df.columns if c not in keys]
    x = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("__x"), F.min(ordinal).alias("__place"))
    return x.select(*keys, *[(F.col("__place") if c == ordinal else F.col(f"__x.{c}")).alias(c) for c in rest])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def content_duplicates(df: DataFrame, content: str, ident: str) -> DataFrame:
    """(id, first_id): rows whose content an earlier id has, by digest."""
    hashed = df.where(F.col(content).isNotNull()).select(ident, F.sha2(F.col(content), 256).alias("digest"))
    firsts = hashed.groupBy("digest").agg(F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashed.join(firsts, "digest").where(F.col(ident) > F.col("first_id")).select(ident, "first_id")


def stratified_sample(df: DataFrame, ident: str, strata: list[str], each: int) -> DataFrame:
    """The ids of the least digests in each stratum of each column: the same rows whenever it is drawn."""
    hashed = df.withColumn("__h", F.sha2(F.col(ident).cast("string"), 256))
    out = None
    for s in strata:
        w = Window.partitionBy(s).orderBy("__h", ident)
        own = hashed.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= each).select(ident)
        out = own if out is None else out.unionByName(own)
    return out.distinct()
