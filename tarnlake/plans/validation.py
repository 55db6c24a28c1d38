"""Queries of record validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import rules, validation
from .registry import query

_LISTED = "array_to_string([x FOR x IN [{}] IF x IS NOT NULL], '|')"


def _case(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN '{text}' END"


def _weights(weights: dict[str, float], conditions: dict[str, str]) -> str:
    return "0.0::DOUBLE + " + " + ".join(f"CASE WHEN {conditions[k]} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for k, w in weights.items())


_SCORE = _weights(validation.SCORE_WEIGHTS, {"official_page": "k % 4 <> 3", "name": "true", "authority": "k % 6 <> 5", "source_evidence": "k % 3 > 0", "objectives": "k % 11 <> 0", "eligibility": "k % 3 <> 0", "benefit": "k % 5 <> 0", "programme_status": "true", "call_status": "kind <> 'APPLICATION_CALL' OR app IN ('OPEN', 'CLOSED')", "application_url": "url = 'OFFICIAL_LINK'"})
_TEXTS, _TODO = validation.DECISION_TEXTS, validation.ACTIONS


@query(f"""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'Call for ' || p_name WHEN 1 THEN 'Board of ' || p_name WHEN 2 THEN 'Fund of Funds' WHEN 3 THEN 'Credit Guarantee' WHEN 4 THEN 'INSPIRE' ELSE p_name END AS name, CASE WHEN p_partkey % 10 = 0 THEN 'ACTIVE_CALL_OPEN' END AS master,
    CASE WHEN p_partkey % 4 > 0 THEN DATE '2024-01-01' + p_size * 10 END AS deadline, CASE p_partkey % 6 WHEN 0 THEN 'GENERIC_OR_UNVERIFIED' WHEN 1 THEN 'OFFICIAL_LINK' ELSE 'NOT_FOUND' END AS url, CASE WHEN p_partkey % 13 = 0 THEN 'DOMAIN' ELSE '' END AS flag FROM part),
  a AS (SELECT *, CASE WHEN master IS NOT NULL OR k % 9 = 0 THEN 'APPLICATION_CALL' WHEN contains(lower(name), 'board') THEN 'UMBRELLA_PROGRAMME' ELSE 'SCHEME_OR_PROGRAMME' END AS kind FROM p),
  b AS (SELECT *, CASE WHEN kind = 'APPLICATION_CALL' THEN CASE WHEN deadline IS NULL THEN 'DEADLINE_UNVERIFIED' WHEN deadline >= DATE '2024-09-01' THEN 'OPEN' ELSE 'CLOSED' END WHEN kind = 'UMBRELLA_PROGRAMME' THEN 'NOT_A_SINGLE_APPLICATION_WINDOW' WHEN k % 9 = 2 THEN 'NOT_DIRECTLY_APPLICABLE_BY_STARTUPS' WHEN k % 9 = 3 THEN 'APPLY_THROUGH_MEMBER_INSTITUTION' WHEN k % 9 = 4 THEN 'COMPONENT_SPECIFIC' WHEN deadline IS NULL THEN 'STATUS_UNVERIFIED' WHEN deadline >= DATE '2024-09-01' THEN 'OPEN' ELSE 'CLOSED' END AS app FROM a),
  c AS (SELECT *, CASE WHEN kind = 'APPLICATION_CALL' THEN CASE WHEN app = 'CLOSED' THEN 'CALL_INFORMATION_AVAILABLE' ELSE 'CALL_INFORMATION_CURRENT' END WHEN kind = 'UMBRELLA_PROGRAMME' THEN 'UMBRELLA_PROGRAMME_INFORMATION_AVAILABLE' ELSE 'SCHEME_INFORMATION_AVAILABLE' END AS programme,
    (k % 3 = 0)::INT + (k % 5 = 0)::INT + (k % 7 = 0 AND kind = 'APPLICATION_CALL')::INT + (k % 2 = 1)::INT + (k % 11 = 0)::INT AS n,
    {_LISTED.format(', '.join([_case('k % 3 = 0', 'ELIGIBILITY_REQUIRES_EVIDENCE'), _case('k % 5 = 0', 'BENEFITS_OR_FUNDING_REQUIRES_EVIDENCE'), _case("k % 7 = 0 AND kind = 'APPLICATION_CALL'", 'APPLICATION_PROCESS_REQUIRES_EVIDENCE'), _case('k % 2 = 1', 'REQUIRED_DOCUMENTS_NOT_VERIFIED'), _case('k % 11 = 0', 'OBJECTIVE_REQUIRES_EVIDENCE')]))} AS warnings,
    {_LISTED.format(', '.join([_case('k % 3 = 0', 'SOURCE_EVIDENCE_MISSING'), _case("k % 3 = 1 AND kind = 'SCHEME_OR_PROGRAMME'", 'SINGLE_SOURCE_ONLY'), _case('k % 2 > 0 AND k % 5 <> 1', 'FUNDING_MENTIONS_NOT_DIRECT_BENEFIT')]))} AS flags FROM b),
  d AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_SCORE} - n * 0.025::DOUBLE - (flag <> '')::INT * 0.25::DOUBLE)) AS s FROM c),
  e AS (SELECT *, CASE WHEN flag <> '' THEN CASE WHEN s < 0.35::DOUBLE THEN 'REJECTED|DOMAIN' ELSE 'NEEDS_MORE_EVIDENCE|DOMAIN' END WHEN kind = 'UMBRELLA_PROGRAMME' THEN 'NEEDS_ADMIN_REVIEW|{_TEXTS['umbrella']}' WHEN app = 'DEADLINE_UNVERIFIED' THEN 'NEEDS_MORE_EVIDENCE|{_TEXTS['deadline']}' WHEN contains(warnings, 'APPLICATION_PROCESS') THEN 'NEEDS_MORE_EVIDENCE|{_TEXTS['process']}' WHEN kind = 'APPLICATION_CALL' AND k % 3 = 0 THEN 'NEEDS_MORE_EVIDENCE|{_TEXTS['eligibility']}' WHEN kind = 'APPLICATION_CALL' AND k % 6 = 0 THEN 'NEEDS_ADMIN_REVIEW|{_TEXTS['link']}'
    WHEN s >= 0.82::DOUBLE THEN 'APPROVED_FOR_DATABASE|{_TEXTS['approved']}' WHEN s >= 0.62::DOUBLE THEN 'NEEDS_ADMIN_REVIEW|{_TEXTS['review']}' WHEN k % 9 = 2 AND k % 2 = 0 THEN 'NEEDS_ADMIN_REVIEW|{_TEXTS['incomplete']}' ELSE 'NEEDS_MORE_EVIDENCE|{_TEXTS['incomplete']}' END AS verdict,
    {_LISTED.format(', '.join([_case('k % 3 = 0', _TODO['ELIGIBILITY_REQUIRES_EVIDENCE']), _case('k % 5 = 0', _TODO['BENEFITS_OR_FUNDING_REQUIRES_EVIDENCE']), _case("contains(warnings, 'APPLICATION_PROCESS')", _TODO['APPLICATION_PROCESS_REQUIRES_EVIDENCE']), _case("kind = 'UMBRELLA_PROGRAMME'", validation.UMBRELLA_ACTION)]))} AS todo FROM d)
  SELECT k AS p_partkey, kind, programme AS programme_status, app AS application_status, warnings, flags, round(s, 6) AS score, verdict, CASE WHEN todo = '' THEN '{validation.NO_ACTION}' ELSE todo END AS actions FROM e""")
def validated_records(t):
    k, as_of = F.col("p_partkey"), F.lit(dt.date(2024, 9, 1))
    name = rules.cascade([(k % 9 == 0, F.concat(F.lit("Call for "), "p_name")), (k % 9 == 1, F.concat(F.lit("Board of "), "p_name")), (k % 9 == 2, "Fund of Funds"), (k % 9 == 3, "Credit Guarantee"), (k % 9 == 4, "INSPIRE")], F.col("p_name"))
    own = t("part").select("p_partkey", name.alias("name"), F.when(k % 10 == 0, "ACTIVE_CALL_OPEN").alias("master"), F.when(k % 4 > 0, F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("p_size") * 10)).alias("deadline"), rules.cascade([(k % 6 == 0, "GENERIC_OR_UNVERIFIED"), (k % 6 == 1, "OFFICIAL_LINK")], "NOT_FOUND").alias("url"), F.when(k % 13 == 0, F.array(F.lit("DOMAIN"))).otherwise(F.array().cast("array<string>")).alias("critical"))
    own = own.withColumn("kind", validation.record_kind(F.col("name"), F.col("master")))
    kind = F.col("kind")
    own = own.withColumn("x", validation.status(kind, F.col("name"), F.col("deadline"), as_of)).select("*", "x.*")
    has = {"eligibility": k % 3 != 0, "benefit": k % 5 != 0, "application_process": k % 7 != 0, "required_documents": k % 2 == 0, "objectives": k % 11 != 0}
    own = own.withColumn("warnings", validation.missing_core(kind, has)).withColumn("flags", validation.evidence_flags(kind, k % 3, k % 2, k % 5 == 1))
    holds = {"official_page": k % 4 != 3, "name": F.col("name") != "", "authority": k % 6 != 5, "source_evidence": k % 3 > 0, "objectives": has["objectives"], "eligibility": has["eligibility"], "benefit": has["benefit"], "programme_status": F.col("programme_status") != "", "call_status": (kind != "APPLICATION_CALL") | F.col("application_status").isin("OPEN", "CLOSED"), "application_url": F.col("url") == "OFFICIAL_LINK"}
    own = own.withColumn("score", validation.score(holds, F.size("warnings"), F.size("critical")))
    own = own.withColumn("d", validation.decision(kind, F.col("name"), F.col("application_status"), F.col("url"), F.col("score"), F.col("warnings"), F.col("critical"), k % 2 == 0))
    verdict = F.concat("d.decision", F.lit("|"), F.array_join("d.reasons", "|"))
    return own.select("p_partkey", "kind", "programme_status", "application_status", F.array_join("warnings", "|").alias("warnings"), F.array_join("flags", "|").alias("flags"), F.round("score", 6).alias("score"), verdict.alias("verdict"), F.array_join(validation.actions(F.col("warnings"), kind), "|").alias("actions"))


@query(r"""SELECT c_custkey, coalesce(CASE c_custkey % 8 WHEN 0 THEN 'a' || c_custkey || '@nic.in' WHEN 2 THEN 'c' || c_custkey || '@x.org' WHEN 3 THEN '+91-98765' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') WHEN 4 THEN CASE WHEN c_custkey % 10000 BETWEEN 2000 AND 2099 THEN NULL ELSE '0112345' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END END, '-') AS contact FROM customer""")
def validated_contacts(t):
    k = F.col("c_custkey")
    kind = rules.cascade([(k % 8 <= 2, "Email"), (k % 8 == 6, "fax")], "phone")
    value = rules.cascade([(k % 8 == 0, F.concat(F.lit("a"), k, F.lit("@nic"))), (k % 8 == 1, F.lit("b@gov")), (k % 8 == 2, F.concat(F.lit(" c"), k, F.lit("@x.org"))), (k % 8 == 3, F.concat(F.lit("+91 98765 "), F.lpad((k % 100000).cast("string"), 5, "0"))), (k % 8 == 4, F.concat(F.lit("011-2345-"), F.lpad((k % 10000).cast("string"), 4, "0"))), (k % 8 == 5, F.lit("12-10-2021 011"))], F.lit("12345"))
    return t("customer").select("c_custkey", F.coalesce(validation.contact(kind, value, F.when(k % 8 == 0, "x[at]NIC[dot]in")), F.lit("-")).alias("contact"))


_HOLDS = {"scheme_name": "k % 50 <> 0", "master_id": "k % 3 <> 0", "official_page_url": "k % 4 <> 0", "source_evidence": "k % 6 <> 0", "official_evidence": "k % 5 <> 0", "implementing_agency": "k % 2 = 0", "eligibility": "k % 7 <> 0", "benefits": "k % 8 <> 0", "application_route": "k % 9 <> 0", "funding_or_scheme_type": "k % 2 = 1", "own_source": "k % 40 <> 1"}
_REASONS = ", ".join(f"CASE WHEN NOT ({_HOLDS[c]}) THEN '{r}' END" for c, r in validation.CHECK_REASONS.items())


@query(f"""WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'CLOSED_OR_DEADLINE_PASSED' WHEN 1 THEN ' open_for  applications' WHEN 2 THEN 'SCHEME_INFORMATION_AVAILABLE_NOW' WHEN 3 THEN 'OPEN_STATUS_REQUIRES_DEADLINE_VERIFICATION' ELSE '' END AS ss, CASE o_orderkey % 5 WHEN 0 THEN 'ACTIVE_CALL_OPEN' WHEN 1 THEN 'HISTORICAL_EVIDENCE_ONLY' WHEN 2 THEN 'SCHEME_INFORMATION_AVAILABLE' ELSE NULL END AS ms, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS closing, (o_orderkey % 100) / 100.0::DOUBLE AS conf FROM orders),
  a AS (SELECT *, (k % 6 = 2 OR k % 5 = 2) AS info, (k % 5 = 0 OR k % 6 = 3) AS active, coalesce(closing < DATE '1998-01-01', false) AS passed FROM o),
  s AS (SELECT *, CASE WHEN info THEN CASE WHEN k % 6 = 0 OR passed THEN 'SCHEME_INFORMATION_AVAILABLE|HISTORICAL_DATE_MENTION_ON_SCHEME_PAGE' ELSE 'SCHEME_INFORMATION_AVAILABLE|' END WHEN active AND closing >= DATE '1998-01-01' THEN 'CALL_INFORMATION_CURRENT|' WHEN active AND passed AND k % 5 = 0 THEN 'CALL_STATUS_CONFLICT_REQUIRES_REVIEW|MASTER_ACTIVE_BUT_EXTRACTED_DEADLINE_PASSED,CALL_STATUS_CONFLICT_REQUIRES_REVIEW' WHEN active AND passed THEN 'CALL_INFORMATION_HISTORICAL|DEADLINE_ALREADY_PASSED' WHEN active THEN 'CALL_INFORMATION_REQUIRES_DEADLINE_VERIFICATION|ACTIVE_CALL_DEADLINE_NOT_VERIFIED'
    WHEN k % 6 = 0 THEN 'CALL_INFORMATION_HISTORICAL|' WHEN k % 5 = 1 THEN 'HISTORICAL_INFORMATION_AVAILABLE|' ELSE 'INFORMATION_REQUIRES_REVIEW|PROGRAMME_STATUS_REQUIRES_REVIEW' END AS st, round(least(1.0::DOUBLE, ({_weights(validation.CHECK_WEIGHTS, _HOLDS)}) * 0.9::DOUBLE + conf * 0.1::DOUBLE), 3) AS score FROM a),
  r AS (SELECT *, split_part(st, '|', 1) AS status, list_sort(list_distinct(list_concat([x FOR x IN string_split(split_part(st, '|', 2), ',') IF x <> ''], [x FOR x IN [{_REASONS}, CASE WHEN k % 30 = 0 THEN 'NO_SOURCE_DOCUMENTS_FETCHED' END] IF x IS NOT NULL]))) AS reasons FROM s)
  SELECT k AS o_orderkey, status, score, array_to_string(reasons, ',') AS reasons, CASE WHEN k % 50 = 0 OR k % 40 = 1 OR (k % 4 = 0 AND k % 6 = 0) OR conf < 0.2::DOUBLE THEN 'REJECTED' WHEN k % 6 = 0 OR (k % 7 = 0 AND k % 8 = 0) OR k % 9 = 0 OR conf < 0.35::DOUBLE THEN 'NEEDS_MORE_EVIDENCE'
    WHEN k % 7 = 0 OR k % 8 = 0 OR k % 5 = 0 OR list_contains(reasons, 'ACTIVE_CALL_DEADLINE_NOT_VERIFIED') OR list_contains(reasons, 'CALL_STATUS_CONFLICT_REQUIRES_REVIEW') OR conf < 0.55::DOUBLE OR score < 0.75::DOUBLE THEN 'NEEDS_ADMIN_REVIEW' ELSE 'APPROVED_FOR_DATABASE' END AS decision FROM r""")
def programme_decisions(t):
    k = F.col("o_orderkey")
    scheme = rules.cascade([(k % 6 == 0, "CLOSED_OR_DEADLINE_PASSED"), (k % 6 == 1, " open_for  applications"), (k % 6 == 2, "SCHEME_INFORMATION_AVAILABLE_NOW"), (k % 6 == 3, "OPEN_STATUS_REQUIRES_DEADLINE_VERIFICATION")], "")
    master = F.when(k % 5 == 0, "ACTIVE_CALL_OPEN").when(k % 5 == 1, "HISTORICAL_EVIDENCE_ONLY").when(k % 5 == 2, "SCHEME_INFORMATION_AVAILABLE")
    holds = {name: F.expr(sql.replace("k ", "o_orderkey ")) for name, sql in _HOLDS.items()}
    confidence = (k % 100) / 100
    own = t("orders").select("o_orderkey", validation.programme_status(scheme, master, F.when(k % 7 != 0, F.col("o_orderdate").cast("date")), F.lit(dt.date(1998, 1, 1))).alias("x"), validation.evidence_score(holds, confidence).alias("score"))
    got = validation.evidence_decision(holds, F.col("score"), confidence, F.col("x.reasons"), k % 30 == 0, reviewable=0.35, approvable=0.55, approval_score=0.75)
    return own.withColumn("d", got).select("o_orderkey", "x.status", "score", F.array_join("d.reasons", ",").alias("reasons"), "d.decision")
