"""Validation of extracted records: kind, status, gaps, flags, score and decision, each an expression over a record's columns.

What a record holds is given as conditions, so that lists, structs and counts of any layout can be told. The day is a parameter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules

#: Words that tell kinds of record, weights, limits, and what is told of a record.
CALL_TERMS = ("call for", "partnerships to drive innovation", "cooperation")
UMBRELLA_TERMS = ("board", "umbrella", "nstedb")
SCORE_WEIGHTS = {"official_page": 0.16, "name": 0.10, "authority": 0.12, "source_evidence": 0.10, "objectives": 0.08, "eligibility": 0.13, "benefit": 0.13, "programme_status": 0.08, "call_status": 0.05, "application_url": 0.05}
APPROVAL_SCORE, REVIEW_SCORE, REJECTION_SCORE = 0.82, 0.62, 0.35
CHECK_WEIGHTS = {
    "scheme_name": 0.10, "master_id": 0.05, "official_page_url": 0.10, "source_evidence": 0.15, "official_evidence": 0.10, "implementing_agency": 0.08, "eligibility": 0.13, "benefits": 0.12, "application_route": 0.09,
    "funding_or_scheme_type": 0.03, "own_source": 0.05,
}
CHECK_REASONS = {"scheme_name": "SCHEME_NAME_MISSING", "master_id": "MASTER_ID_MISSING", "official_page_url": "OFFICIAL_PAGE_URL_MISSING", "source_evidence": "SOURCE_EVIDENCE_MISSING", "official_evidence": "OFFICIAL_MEITY_EVIDENCE_MISSING", "eligibility": "ELIGIBILITY_NOT_FOUND", "benefits": "BENEFITS_NOT_FOUND", "application_route": "APPLICATION_ROUTE_NOT_FOUND"}
DECISION_TEXTS = {
    "umbrella": "Umbrella programme should be split into component schemes before publication.", "deadline": "Current call deadline could not be verified.", "process": "Call is discoverable, but the application process is incomplete.",
    "eligibility": "Eligibility is required before the call can be published.", "link": "A scheme-specific application link must be confirmed.", "approved": "Official source, core content, lifecycle status, and financial evidence meet the publication threshold.",
    "review": "Record is credible but one or more fields require admin confirmation.", "incomplete": "Core eligibility, benefit, application, or status evidence is incomplete.",
}
ACTIONS = {
    "ELIGIBILITY_REQUIRES_EVIDENCE": "Confirm eligibility from the official guideline, RFP, or application portal.", "BENEFITS_OR_FUNDING_REQUIRES_EVIDENCE": "Confirm the exact financial/non-financial benefit and beneficiary-level limit.",
    "APPLICATION_PROCESS_REQUIRES_EVIDENCE": "Confirm the step-by-step application process and official application link.", "ACTIVE_CALL_DEADLINE_UNVERIFIED": "Confirm the latest closing date or extension notice.",
}
UMBRELLA_ACTION = "Create separate records for each component programme instead of publishing the umbrella page as one scheme."
NO_ACTION = "Review corrections and approve or edit the normalized record."
MAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def _contains_any(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def _some(*told: tuple[Column, str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in told]), lambda x: x.isNotNull())


def _pair(cases: list[tuple[Column, str, str]], default: tuple[str, str], names: tuple[str, str]) -> Column:
    made = lambda a, b: F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]))
    return rules.cascade([(c, made(a, b)) for c, a, b in cases], made(*default))


def record_kind(name: Column, master_status: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return rules.cascade([(F.coalesce(master_status == "ACTIVE_CALL_OPEN", F.lit(False)) | _contains_any(n, CALL_TERMS), "APPLICATION_CALL"), (_contains_any(n, UMBRELLA_TERMS), "UMBRELLA_PROGRAMME")], "SCHEME_OR_PROGRAMME")


def status(kind: Column, name: Column, deadline: Column, as_of: Column) -> Column:
    """struct(programme_status, application_status); the deadline is a date or null."""
    n, call = F.lower(F.coalesce(name, F.lit(""))), kind == "APPLICATION_CALL"
    info = "SCHEME_INFORMATION_AVAILABLE"
    cases = [
        (call & deadline.isNull(), "CALL_INFORMATION_CURRENT", "DEADLINE_UNVERIFIED"), (call & (deadline >= as_of), "CALL_INFORMATION_CURRENT", "OPEN"), (call, "CALL_INFORMATION_AVAILABLE", "CLOSED"),
        (kind == "UMBRELLA_PROGRAMME", "UMBRELLA_PROGRAMME_INFORMATION_AVAILABLE", "NOT_A_SINGLE_APPLICATION_WINDOW"), (F.contains(n, F.lit("fund of funds")), info, "NOT_DIRECTLY_APPLICABLE_BY_STARTUPS"),
        (F.contains(n, F.lit("credit guarantee")), info, "APPLY_THROUGH_MEMBER_INSTITUTION"), (F.contains(n, F.lit("inspire")), info, "COMPONENT_SPECIFIC"), (deadline >= as_of, info, "OPEN"), (deadline.isNotNull(), info, "CLOSED"),
    ]
    return _pair(cases, (info, "STATUS_UNVERIFIED"), ("programme_status", "application_status"))


def missing_core(kind: Column, has: Mapping[str, Column]) -> Column:
    """Warnings of what a record lacks; has: eligibility, benefit (a benefit or an amount), application_process, required_documents, objectives."""
    return _some((~has["eligibility"], "ELIGIBILITY_REQUIRES_EVIDENCE"), (~has["benefit"], "BENEFITS_OR_FUNDING_REQUIRES_EVIDENCE"), (~has["application_process"] & (kind == "APPLICATION_CALL"), "APPLICATION_PROCESS_REQUIRES_EVIDENCE"), (~has["required_documents"], "REQUIRED_DOCUMENTS_NOT_VERIFIED"), (~has["objectives"], "OBJECTIVE_REQUIRES_EVIDENCE"))


def evidence_flags(kind: Column, sources: Column, mentions: Column, has_amount: Column) -> Column:
    """Flags by the numbers of sources and of amounts that are mentioned."""
    return _some((sources == 0, "SOURCE_EVIDENCE_MISSING"), ((kind == "SCHEME_OR_PROGRAMME") & (sources == 1), "SINGLE_SOURCE_ONLY"), ((mentions > 0) & ~has_amount, "FUNDING_MENTIONS_NOT_DIRECT_BENEFIT"))


def score(holds: Mapping[str, Column], warnings: Column, critical: Column) -> Column:
    """The weights of what holds (SCORE_WEIGHTS), less 0.025 a warning and 0.25 a critical flag, from 0 to 1."""
    total = sum((F.when(holds[k], w).otherwise(0.0) for k, w in SCORE_WEIGHTS.items()), F.lit(0.0)) - warnings * 0.025 - critical * 0.25
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def decision(kind: Column, name: Column, application_status: Column, url_status: Column, points: Column, warnings: Column, critical: Column, has_corpus: Column) -> Column:
    """struct(decision, reasons); warnings and critical are arrays."""
    call, warned = kind == "APPLICATION_CALL", lambda w: F.array_contains(warnings, w)
    made = lambda d, r: F.struct(F.lit(d).alias("decision"), (r if isinstance(r, Column) else F.array(F.lit(DECISION_TEXTS[r]))).alias("reasons"))
    more, admin = "NEEDS_MORE_EVIDENCE", "NEEDS_ADMIN_REVIEW"
    return rules.cascade(
        [
            ((F.size(critical) > 0) & (points < REJECTION_SCORE), made("REJECTED", critical)), (F.size(critical) > 0, made(more, critical)), (kind == "UMBRELLA_PROGRAMME", made(admin, "umbrella")), (call & (application_status == "DEADLINE_UNVERIFIED"), made(more, "deadline")),
            (call & warned("APPLICATION_PROCESS_REQUIRES_EVIDENCE"), made(more, "process")), (call & warned("ELIGIBILITY_REQUIRES_EVIDENCE"), made(more, "eligibility")), (call & (url_status == "GENERIC_OR_UNVERIFIED"), made(admin, "link")),
            (points >= APPROVAL_SCORE, made("APPROVED_FOR_DATABASE", "approved")), (points >= REVIEW_SCORE, made(admin, "review")), (F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("fund of funds")) & has_corpus, made(admin, "incomplete")),
        ],
        made(more, "incomplete"),
    )


def actions(warnings: Column, kind: Column) -> Column:
    """What to do about a record's warnings, in order."""
    own = _some(*[(F.array_contains(warnings, w), t) for w, t in ACTIONS.items()], (kind == "UMBRELLA_PROGRAMME", UMBRELLA_ACTION))
    return F.when(F.size(own) == 0, F.array(F.lit(NO_ACTION))).otherwise(own)


def contact(kind: Column, value: Column, evidence: Column) -> Column:
    """A contact's repaired value, or null if it is none: addresses cut before .in are told by the evidence, phones have 10 to 12 digits."""
    k, v, seen = F.lower(F.coalesce(kind, F.lit(""))), F.trim(F.coalesce(value, F.lit(""))), F.lower(F.coalesce(evidence, F.lit("")))
    cut = (v.endswith("@nic") & F.contains(seen, F.lit("[at]nic[dot]in"))) | (v.endswith("@gov") & F.contains(seen, F.lit("[at]gov[dot]in")))
    mail = F.when(cut, F.concat(v, F.lit(".in"))).otherwise(v)
    digits = F.regexp_replace(v, r"\D", "")
    phone = F.when(digits.startswith("91") & (F.length(digits) == 12), F.concat(F.lit("+91-"), F.substring(digits, 3, 10))).otherwise(digits)
    dated = v.rlike(r"\b20\d\d\b|\d-\d\d?-20\d\d")  # a year of this century by itself, or a whole day
    return F.when((k == "email") & mail.rlike(MAIL), mail).when((k == "phone") & ~dated & F.length(digits).between(10, 12), phone)


def programme_status(scheme_status: Column, master_status: Column, closing: Column, as_of: Column) -> Column:
    """struct(status, reasons) of an incremental record; closing is a date or null."""
    s, m = F.upper(T.norm(scheme_status)), F.upper(T.norm(master_status))
    info = (m == "SCHEME_INFORMATION_AVAILABLE") | s.startswith("SCHEME_INFORMATION_AVAILABLE")
    active = (m == "ACTIVE_CALL_OPEN") | s.isin("OPEN_FOR_APPLICATIONS", "OPEN_STATUS_REQUIRES_DEADLINE_VERIFICATION")
    passed = F.coalesce(closing < as_of, F.lit(False))
    made = lambda status_, *reasons: F.struct(F.lit(status_).alias("status"), (F.array(*[F.lit(r) for r in reasons]) if reasons else F.array().cast("array<string>")).alias("reasons"))
    return rules.cascade(
        [
            (info & ((s == "CLOSED_OR_DEADLINE_PASSED") | passed), made("SCHEME_INFORMATION_AVAILABLE", "HISTORICAL_DATE_MENTION_ON_SCHEME_PAGE")), (info, made("SCHEME_INFORMATION_AVAILABLE")), (active & F.coalesce(closing >= as_of, F.lit(False)), made("CALL_INFORMATION_CURRENT")),
            (active & passed & (m == "ACTIVE_CALL_OPEN"), made("CALL_STATUS_CONFLICT_REQUIRES_REVIEW", "MASTER_ACTIVE_BUT_EXTRACTED_DEADLINE_PASSED", "CALL_STATUS_CONFLICT_REQUIRES_REVIEW")), (active & passed, made("CALL_INFORMATION_HISTORICAL", "DEADLINE_ALREADY_PASSED")),
            (active, made("CALL_INFORMATION_REQUIRES_DEADLINE_VERIFICATION", "ACTIVE_CALL_DEADLINE_NOT_VERIFIED")), (s == "CLOSED_OR_DEADLINE_PASSED", made("CALL_INFORMATION_HISTORICAL")), (m == "HISTORICAL_EVIDENCE_ONLY", made("HISTORICAL_INFORMATION_AVAILABLE")),
        ],
        made("INFORMATION_REQUIRES_REVIEW", "PROGRAMME_STATUS_REQUIRES_REVIEW"),
    )


def evidence_score(holds: Mapping[str, Column], confidence: Column) -> Column:
    """0.9 of the weights of the checks that hold (CHECK_WEIGHTS) and 0.1 of the confidence, at most 1, to three places."""
    own = sum((F.when(holds[k], w).otherwise(0.0) for k, w in CHECK_WEIGHTS.items()), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), own * 0.9 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))) * 0.1), 3)


def evidence_decision(holds: Mapping[str, Column], points: Column, confidence: Column, reasons: Column, nothing_fetched: Column, *, reviewable: float, approvable: float, approval_score: float) -> Column:
    """struct(decision, reasons) of an incremental record; reasons are those of programme_status, the result's are sorted and distinct."""
    c = F.coalesce(confidence, F.lit(0.0))
    told = F.concat(reasons, _some(*[(~holds[k], r) for k, r in CHECK_REASONS.items()], (nothing_fetched, "NO_SOURCE_DOCUMENTS_FETCHED")))
    fatal = ~holds["scheme_name"] | ~holds["own_source"] | (~holds["official_page_url"] & ~holds["source_evidence"]) | (c < 0.20)
    gap = ~holds["source_evidence"] | (~holds["eligibility"] & ~holds["benefits"]) | ~holds["application_route"] | (c < reviewable)
    open_ = F.array_contains(told, "ACTIVE_CALL_DEADLINE_NOT_VERIFIED") | F.array_contains(told, "CALL_STATUS_CONFLICT_REQUIRES_REVIEW")
    blocked = ~holds["eligibility"] | ~holds["benefits"] | ~holds["official_evidence"] | open_ | (c < approvable) | (points < approval_score)
    verdict = rules.cascade([(fatal, "REJECTED"), (gap, "NEEDS_MORE_EVIDENCE"), (blocked, "NEEDS_ADMIN_REVIEW")], "APPROVED_FOR_DATABASE")
    return F.struct(verdict.alias("decision"), F.sort_array(F.array_distinct(told)).alias("reasons"))
