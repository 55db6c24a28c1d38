"""Invariants, publication control, review state and audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def unique_ids(df: DataFrame, key: str) -> dict[str, Column]:
    """Aggregates that tell blank and repeated ids."""
    k = T.blank_to_null(F.col(key))
    return {"blank_ids": F.count_if(k.isNull()), "repeated_ids": F.count(k) - F.count_distinct(k)}


def invariants(df: DataFrame, key: str, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """(check, failures): blank ids, repeated ids, and values outside their domains; one scan for all."""
    named = unique_ids(df, key) | {f"outside_{c}": F.count_if(~F.coalesce(F.col(c).isin(*values), F.lit(False))) for c, values in domains.items()}
    one = df.agg(*[c.cast("long").alias(n) for n, c in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in named])).alias("x")).select("x.*")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of child whose key parent lacks; null keys are no reference."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def null_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """child with references to missing parents made null."""
    known = parent.select(F.col(pk).alias("__pk")).distinct()
    return child.join(known, F.col(fk) == F.col("__pk"), "left").withColumn(fk, F.when(F.col("__pk").isNotNull(), F.col(fk))).drop("__pk")


def same_rows(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(missing, extra): rows of one frame that the other lacks, repeated ones counted."""
    a, b = before.select(*columns), after.select(*columns)
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("extra")))  # one row each


def fill_blank(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Blank values of df are filled from other by key; other's first value by order of text counts."""
    values = other.groupBy(key).agg(*[F.min(T.blank_to_null(F.col(c))).alias(f"__{c}") for c in columns])
    joined = df.join(values, key, "left")
    return joined.select(*[(F.coalesce(T.blank_to_null(F.col(c)), F.col(f"__{c}")) if c in columns else F.col(c)).alias(c) for c in df.columns])


def protected_missing(active: DataFrame, candidate: DataFrame, approved: DataFrame, key: str) -> DataFrame:
    """Active rows that the candidate drops without approval."""
    return active.select(key).join(candidate.select(key), key, "left_anti").join(approved.select(key), key, "left_anti")


def bulk_action(rows: DataFrame, wanted: DataFrame, key: str, *, state: str, version: str, allowed: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """(key, outcome, next_state, next_version, is_public) of a bulk transition.

    wanted: (key, action, expected_version). A row moves only from the version that was seen; allowed lists (state, action,
    next state, is_public). Outcomes: MOVED, STALE, NOT_ALLOWED, MISSING.
    """
    table = rows.sparkSession.createDataFrame(list(allowed), "__from string, __do string, __to string, __public int")
    w = wanted.select(key, "action", "expected_version")
    own = rows.select(key, F.col(state).alias("__state"), F.col(version).alias("__version"))
    j = w.join(own, key, "left").join(F.broadcast(table), (F.col("__state") == F.col("__from")) & (F.col("action") == F.col("__do")), "left")
    outcome = F.when(F.col("__state").isNull(), "MISSING").when(F.col("__version") != F.col("expected_version"), "STALE").when(F.col("__to").isNull(), "NOT_ALLOWED").otherwise("MOVED")
    moved = outcome == "MOVED"
    return j.select(key, outcome.alias("outcome"), F.when(moved, F.col("__to")).otherwise(F.col("__state")).alias("next_state"), F.when(moved, F.col("__version") + 1).otherwise(F.col("__version")).alias("next_version"), F.when(moved, F.col("__public")).alias("is_public"))


def audit_rows(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, old_value, new_value): a row for each value that changed."""
    b = before.select(key, *[F.col(c).cast("string").alias(f"__b{i}") for i, c in enumerate(columns)])
    a = after.select(key, *[F.col(c).cast("string").alias(f"__a{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__b{i}").alias("old_value"), F.col(f"__a{i}").alias("new_value")) for i, c in enumerate(columns)])
    return b.join(a, key).select(key, F.explode(each).alias("x")).select(key, "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def evidence_rows(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, evidence, digest): the fields that are not blank, turned into rows."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), T.blank_to_null(F.col(f)).alias("evidence")) for f in fields])
    return df.select(key, F.explode(each).alias("x")).select(key, "x.*").where(F.col("evidence").isNotNull()).withColumn("digest", F.sha2("evidence", 256))


def tagged_union(tables: Mapping[str, DataFrame], columns: Sequence[str], tag: str = "entity_type") -> DataFrame:
    """All rows with the name of their table; columns that a table lacks are null."""
    out = None
    for name, df in tables.items():
        own = df.select(F.lit(name).alias(tag), *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])
        out = own if out is None else out.unionByName(own)
    return out


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, blanks, distinct_values) of each column, in one scan."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(T.is_blank(F.col(c))).alias(f"__b{i}") for i, c in enumerate(columns)], *[F.count_distinct(T.blank_to_null(F.col(c))).alias(f"__d{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("__n").alias("rows"), F.col(f"__b{i}").alias("blanks"), F.col(f"__d{i}").alias("distinct_values")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent) of each value, blank ones as <blank>; percent of all rows to two places."""
    counts = df.groupBy(F.coalesce(T.blank_to_null(F.col(column)), F.lit("<blank>")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).cast("double").alias("percent"))  # the total is one row
