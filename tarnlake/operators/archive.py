"""Assessment of past calls, and manifests with signatures."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

#: Fixed values.
STATES = ("AUTO_QUALIFIED", "QUALIFIED_WITH_WARNINGS", "EXCEPTION_REVIEW", "CURRENT_EXCLUDED")


def assess(df: DataFrame, status: Column, closing: Column, as_of: Column, identity: Column, warnings: list[Column], blockers: list[Column]) -> DataFrame:
    """Adds archive_state and blockers, the number of reasons against. Identities held by several rows block all of them."""
    keyed = df.withColumn("__identity", identity)
    many = keyed.groupBy("__identity").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = keyed.join(many, "__identity", "left")
    reasons = [status != "CLOSED", closing.isNull(), F.coalesce(closing >= as_of, F.lit(False)), F.col("__n").isNotNull(), *blockers]
    n = sum((F.when(r, 1).otherwise(0) for r in reasons), F.lit(0))
    w = sum((F.when(r, 1).otherwise(0) for r in warnings), F.lit(0))
    state = rules.cascade([(status.isin("OPEN", "UPCOMING"), "CURRENT_EXCLUDED"), (n > 0, "EXCEPTION_REVIEW"), (w > 0, "QUALIFIED_WITH_WARNINGS")], "AUTO_QUALIFIED")
    return joined.withColumn("archive_state", state).withColumn("blockers", F.when(state == "CURRENT_EXCLUDED", 0).otherwise(n)).drop("__identity", "__n")


def manifest(df: DataFrame, state: str, year: str, sample: DataFrame, ident: str) -> DataFrame:
    """One row: total, counts by state and year as canonical JSON, sampled ids, and a SHA-256 signature of all of it.

    Only counts and the sample come together; what they hold is bounded by states, years and the sample's size.
    """
    states = {r[0]: r[1] for r in df.groupBy(state).count().collect()}
    years = {str(r[0]): r[1] for r in df.where(F.col(state).startswith("AUTO") | F.col(state).startswith("QUAL")).groupBy(year).count().collect()}
    ids = sorted(str(r[0]) for r in sample.select(ident).collect())
    body = {"total": sum(states.values()), "state_counts": states, "year_counts": years, "sample_ids": ids}
    text = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    row = (body["total"], json.dumps(states, sort_keys=True, separators=(",", ":")), json.dumps(years, sort_keys=True, separators=(",", ":")), len(ids), hashlib.sha256(text.encode()).hexdigest())
    return df.sparkSession.createDataFrame([row], "total long, state_counts string, year_counts string, sample_size int, signature string")
