"""Explainable matching of a profile with catalogue records, and the catalogue's filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money


#: What is told of a match.
NO_MATCH = "No strong structured match was found; review the official source before acting."
ACTIONABLE = "The opportunity is currently actionable in the catalogue status data."
CLOSED_REFERENCE = "The record is closed or historical, so it is useful for reference rather than immediate application."
CLOSED_WANTED = "Closed and historical records are included by your preference."
UPCOMING = "The record appears upcoming based on structured status/date data."
UNVERIFIED = "Application status requires verification before acting."
SCOPE_MET = "Geographic scope appears compatible."
SCOPE_MISSING = "Geographic scope data is missing for this record."
FUNDING_MET = "Recorded structured funding can meet or exceed the requested amount."
FUNDING_MISSING = "Structured funding data is missing for this record."
STATUS, SCOPE, FUNDING = "application status", "geographic scope", "funding requirement"


def explain(bucket: Column, profile: dict, *, applicants: Column, sectors: Column, stages: Column, scope: Column, amounts: Column) -> Column:
    """struct(score, matched, unmatched, reasons, warnings) of a record; score is 0 to 100, the lists but reasons are sorted.

    Each finding is a condition with its points and what it adds to the lists; conditions of one subject exclude each other.
    """
    findings: list[tuple[Column, int, dict[str, str]]] = []

    def found(condition: Column, points: int = 0, **told: str) -> None:
        findings.append((F.coalesce(condition, F.lit(False)), points, told))

    closed = bucket.isin("CLOSED", "HISTORICAL")
    found(bucket.isin("OPEN", "CLOSING_SOON"), 15, matched=STATUS, reasons=ACTIONABLE)
    if profile.get("include_closed"):
        found(closed, 3, reasons=CLOSED_WANTED)
    else:
        found(closed, unmatched=STATUS, reasons=CLOSED_REFERENCE)
    if profile.get("include_verification_required", True):
        found(bucket == "VERIFICATION_REQUIRED", 5, warnings=UNVERIFIED)
    else:
        found(bucket == "VERIFICATION_REQUIRED", unmatched=STATUS)
    found(bucket == "UPCOMING", 10, matched=STATUS, reasons=UPCOMING)
    for column, name, weight, field in ((applicants, "applicant_types", 25, "applicant type"), (sectors, "sectors", 25, "sector"), (stages, "startup_stages", 20, "startup stage")):
        wanted = sorted({w.strip().lower() for w in profile.get(name, ()) if w.strip()})
        if wanted:
            own = F.filter(F.transform(F.coalesce(column, F.array()).cast("array<string>"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
            met = F.arrays_overlap(own, F.array(*[F.lit(w) for w in wanted]))
            found(F.size(own) == 0, unmatched=field, warnings=f"{field} data is missing for this record.")
            found((F.size(own) > 0) & met, weight, matched=field, reasons=f"Matched {field} against structured catalogue fields.")
            found((F.size(own) > 0) & ~met, unmatched=field)
    if want := profile.get("geographic_scope"):
        own = F.lower(F.coalesce(scope, F.lit("")))
        met = F.contains(own, F.lit(want.lower())) | F.contains(own, F.lit("national"))
        found(own == "", warnings=SCOPE_MISSING)
        found((own != "") & met, 10, matched=SCOPE, reasons=SCOPE_MET)
        found((own != "") & ~met, unmatched=SCOPE)
    if need := profile.get("funding_requirement"):
        most = F.array_max(F.coalesce(amounts, F.array().cast("array<long>")))
        found(most.isNull(), warnings=FUNDING_MISSING)
        found(most >= need, 5, matched=FUNDING, reasons=FUNDING_MET)
        found(most < need, unmatched=FUNDING)

    def told(name: str) -> Column:
        return F.filter(F.array(*[F.when(c, F.lit(x[name])) for c, _, x in findings if name in x], F.lit(None).cast("string")), lambda x: x.isNotNull())

    points = sum((F.when(c, p).otherwise(0) for c, p, _ in findings if p), F.lit(0))
    reasons = F.when(F.size(told("reasons")) == 0, F.array(F.lit(NO_MATCH))).otherwise(told("reasons"))
    lists = [F.sort_array(F.array_distinct(told(n))).alias(n) for n in ("matched", "unmatched", "warnings")]
    return F.struct(F.greatest(F.lit(0), F.least(points, F.lit(100))).alias("score"), lists[0], lists[1], reasons.alias("reasons"), lists[2])


def score(df: DataFrame, bucket: Column, profile: dict, **fields: Column) -> DataFrame:
    """Adds score and what explains it (explain) as columns, unmatched as one text; rows that the profile leaves out go."""
    kept = df if profile.get("include_closed") else df.where(~bucket.isin("CLOSED", "HISTORICAL"))
    if not profile.get("include_verification_required", True):
        kept = kept.where(bucket != "VERIFICATION_REQUIRED")
    own = kept.withColumn("__match", explain(bucket, profile, **fields))
    return own.withColumns({n: F.col(f"__match.{n}") for n in ("score", "matched", "reasons", "warnings")}).withColumn("unmatched", F.array_join("__match.unmatched", ",")).drop("__match")


def top(scored: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """The highest scores; equal ones by name from Z to A."""
    return scored.orderBy(F.desc("score"), F.desc(F.lower(name))).limit(limit)


def filtered(df: DataFrame, bucket: Column, state: dict, *, blob: Column | None = None, facets: dict[str, Column] | None = None, amounts: Column | None = None, opening: Column | None = None, closing: Column | None = None) -> DataFrame:
    """Rows that pass all filters of state; missing dates pass date filters."""
    out = df
    if (k := state.get("keyword", "").strip().lower()) and blob is not None:
        out = out.where(F.contains(blob, F.lit(k)))
    for name, column in (facets or {}).items():
        if wanted := state.get(name):
            out = out.where(column.isin(*wanted))
    if wanted := state.get("statuses"):
        out = out.where(bucket.isin(*wanted))
    if not state.get("include_archived", True):
        out = out.where(~bucket.isin("CLOSED", "HISTORICAL"))
    if not state.get("include_verification_required", True):
        out = out.where(bucket != "VERIFICATION_REQUIRED")
    if amounts is not None and (state.get("min_funding") is not None or state.get("max_funding") is not None):
        out = out.where(money.within(amounts, state.get("min_funding"), state.get("max_funding")))
    if state.get("opening_from") is not None:
        out = out.where(opening.isNull() | (opening >= F.lit(state["opening_from"])))
    if state.get("closing_to") is not None:
        out = out.where(closing.isNull() | (closing <= F.lit(state["closing_to"])))
    return out
