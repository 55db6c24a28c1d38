"""Status of programmes and calls on a given day. All take and return Columns; the day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
OPEN = ("OPEN", "OPEN_FOR_APPLICATIONS", "ACTIVE_APPLICATION_WINDOW")
UPCOMING = ("UPCOMING", "COMING_SOON", "ANNOUNCED")
UNVERIFIED = ("DEADLINE_UNVERIFIED", "STATUS_UNVERIFIED", "CALL_STATUS_CONFLICT_REQUIRES_REVIEW")
LABELS = {"OPEN": "Open Now", "CLOSING_SOON": "Closing Soon", "UPCOMING": "Upcoming", "VERIFICATION_REQUIRED": "Verification Required", "CLOSED": "Closed", "HISTORICAL": "Historical", "REFERENCE": "Reference"}
CENTRAL = ("central", "central government", "union government", "national government")
STATE = ("state", "state/ut", "state government", "state governments", "ut", "union territory")
LEVELS = ("Central Government", "State Government", "Unspecified")


def token(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def bucket(status: Column, opening: Column, closing: Column, as_of: Column, *, section: Column | None = None, inclusion: Column | None = None, soon: int = 30) -> Column:
    """One of LABELS' keys; opening and closing are dates or null."""
    s, sec, inc = token(status), token(section if section is not None else F.lit("")), token(inclusion if inclusion is not None else F.lit(""))
    unverified = (inc == "PENDING_REVALIDATION") | F.contains(sec, F.lit("VERIFICATION"))
    for m in UNVERIFIED:
        unverified = unverified | F.contains(s, F.lit(m))
    is_open = s.isin(*OPEN)
    return (
        F.when(F.contains(sec, F.lit("HISTORICAL")), "HISTORICAL")
        .when(F.contains(s, F.lit("CLOSED")) | F.contains(sec, F.lit("CLOSED")), "CLOSED")
        .when(unverified, "VERIFICATION_REQUIRED")
        .when(closing < as_of, "CLOSED")
        .when(is_open & (closing <= F.date_add(as_of, soon)), "CLOSING_SOON")
        .when(is_open, "OPEN")
        .when(s.isin(*UPCOMING) | (opening > as_of), "UPCOMING")
        .otherwise("REFERENCE")
    )


def label(b: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[b], F.lit("Reference"))


def call_status(opening: Column, closing: Column, as_of: Column) -> Column:
    """What the dates alone assert."""
    return F.when(closing < as_of, "CLOSED").when(opening > as_of, "UPCOMING").when((opening <= as_of) & (as_of <= closing), "OPEN").otherwise("STATUS_UNVERIFIED")


def level(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(t.isin(*CENTRAL), LEVELS[0]).when(t.isin(*STATE), LEVELS[1]).otherwise(LEVELS[2])
