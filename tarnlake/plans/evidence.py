"""Queries of evidence in texts and of checks of addresses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import evidence, rules
from .registry import query


@query("""WITH p AS (SELECT p_brand, p_partkey, p_size, p_type, CASE p_partkey % 8 WHEN 0 THEN 'BENEFICIARY_LIMIT' WHEN 1 THEN 'SCHEME_CORPUS' WHEN 2 THEN 'INTERMEDIARY_LIMIT' WHEN 3 THEN 'GENERAL_FINANCIAL_MENTION' WHEN 4 THEN 'ELIGIBILITY_THRESHOLD' WHEN 7 THEN 'BENEFICIARY_LIMIT' END AS role,
    CASE p_partkey % 8 WHEN 0 THEN p_size * 100000 WHEN 1 THEN p_size * 10000000 WHEN 2 THEN p_size * 1000000 WHEN 3 THEN p_size * 100 WHEN 4 THEN p_size * 1000 WHEN 7 THEN p_size * 10000000 END AS amount FROM part),
  m AS (SELECT DISTINCT p_brand, amount, role, p_type FROM p WHERE role IS NOT NULL AND amount >= 1000)
  SELECT p_brand, CASE WHEN min(amount) FILTER (role = 'BENEFICIARY_LIMIT') < max(amount) FILTER (role = 'BENEFICIARY_LIMIT') THEN min(amount) FILTER (role = 'BENEFICIARY_LIMIT') END AS minimum, max(amount) FILTER (role = 'BENEFICIARY_LIMIT') AS maximum,
    max(amount) FILTER (role = 'INTERMEDIARY_LIMIT') AS intermediary, max(amount) FILTER (role = 'SCHEME_CORPUS') AS corpus, count(*) AS mentions FROM m GROUP BY 1""")
def funding_evidence(t):
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    said = [
        (k == 0, F.concat(F.lit("support up to Rs. "), size, F.lit(" lakh each"))), (k == 1, F.concat(F.lit("with a  total corpus of INR "), size, F.lit(" (in all) Crores"))), (k == 2, F.concat(F.lit("for a selected incubator ₹ "), size, F.lit(" million"))),
        (k == 3, F.concat(F.lit("about Rs "), size, F.lit("00"))), (k == 4, F.concat(F.lit("eligibility from INR "), size, F.lit(",000"))), (k == 5, F.concat(F.lit("for example Rs "), size, F.lit(" lakh"))),
        (k == 6, F.concat(F.lit("section 4.2 of Rs "), size, F.lit(" lakh"))),
    ]
    own = t("part").select("p_brand", rules.cascade(said, F.concat(F.lit("a grant of up to Rs"), size, F.lit("cr."))).alias("context"), "p_type")
    return evidence.funding(evidence.money_mentions(own, "p_brand", "context", "p_type"), "p_brand")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate::DATE AS d FROM orders)
  SELECT o_orderkey, (CASE k WHEN 4 THEN DATE '2001-02-03' WHEN 3 THEN DATE '2050-06-07' ELSE make_date((2000 + year(d) % 30)::INT, month(d1)::INT, day(d1)::INT) END)::VARCHAR AS deadline,
    CASE k WHEN 4 THEN 'extractor-value' ELSE 'deadline-context-validation' END AS method, CASE k WHEN 0 THEN 0.98 WHEN 1 THEN 0.85 WHEN 2 THEN 0.98 WHEN 3 THEN 0.69 ELSE 0.7 END::DOUBLE AS confidence
  FROM (SELECT *, CASE WHEN month(d) = 2 AND day(d) = 29 THEN d - 1 ELSE d END AS d1 FROM o)""")
def deadline_evidence(t):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    d = F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), F.date_sub(d, 1)).otherwise(d)
    year = (F.lit(2000) + F.year(d) % 30).cast("string")
    numbers, named = F.concat(F.date_format(d, "dd-MM-"), year), F.concat(F.date_format(d, "d MMMM "), year)
    far = "z" * 75
    said = [
        (k == 0, F.concat(F.lit("Last date to apply: "), numbers, F.lit(". "), F.lit("w " * 130), F.lit("Announcement date 01/01/2099."))), (k == 1, F.concat(F.lit(f"The closing date {far} is "), named, F.lit("."))),
        (k == 2, F.concat(F.lit("Deadline for startup to apply "), named, F.lit(", not " + "v " * 100 + "starting date 02/03/2098"))), (k == 3, F.lit("last date " + "u" * 200 + " 7th June 2050")),
    ]
    own = t("orders").select("o_orderkey", rules.cascade(said, F.concat(F.lit("On "), numbers)).alias("x"), F.lit("2001-02-03").alias("closing"))
    return evidence.deadlines(own, "o_orderkey", "x", "closing").select("o_orderkey", F.col("deadline").cast("string").alias("deadline"), "method", F.round("confidence", 4).alias("confidence"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber <> 4 AS deadline_ok, l_linenumber IN (1, 2, 3) AND NOT l_extendedprice::DECIMAL(20,0) BETWEEN 1900 AND 2100 OR l_linenumber = 7 AS amount_ok,
  CASE l_linenumber WHEN 1 THEN l_shipdate::DATE >= DATE '1997-01-01' WHEN 2 THEN l_shipdate::DATE < DATE '1997-01-01' WHEN 3 THEN true ELSE false END AS status_ok FROM lineitem""")
def supported_values(t):
    n, day = F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    amount = F.col("l_extendedprice").cast("decimal(20,0)")
    plain, marked = amount.cast("string"), F.format_number(amount, 0)
    shown = F.when(n == 1, F.date_format(day, "d MMMM yyyy")).when(n == 2, F.date_format(day, "dd/MM/yyyy")).when(n == 4, F.lit("some day")).otherwise(F.date_format(day, "MMMM dd, yyyy"))
    deadline = F.when(n == 1, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    said = F.when(n == 1, F.concat(F.lit("grant of "), plain)).when(n == 2, F.concat(marked, F.lit(" rupees"))).when(n == 3, F.concat(F.lit("INR "), plain, F.lit(".00 a head"))).otherwise(F.concat(plain, F.lit(" heads")))
    status = rules.cascade([(n == 1, "open"), (n == 2, "CALL_CLOSED"), (n == 3, "CALL_INFORMATION_AVAILABLE"), (n == 5, "HISTORICAL_EVIDENCE_ONLY"), (n == 6, " ")], "OTHER")
    as_of, text = F.lit(dt.date(1997, 1, 1)), F.when(n == 3, "a Grant").otherwise("none")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", evidence.deadline_supported(deadline, F.concat(F.lit("Until "), shown, F.lit("."))).alias("deadline_ok"), evidence.amount_supported(F.when(n == 7, "").otherwise(plain), said).alias("amount_ok"),
        evidence.status_supported(status, text, deadline, as_of).alias("status_ok"),
    )


_WORDS = ", ".join(f"'{w}'" for w in evidence.PROGRAMME_WORDS)


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS x, trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS n FROM documents),
  w AS (SELECT doc_id, n, len(list_filter([{_WORDS}], lambda p: contains(x, p))) AS hits FROM d)
  SELECT doc_id, round(least(1.0, 0.4 * (doc_id % 5) / 4.0 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 0.1 END + CASE WHEN contains(n, CASE WHEN doc_id % 3 = 0 THEN 'home' ELSE 'that this' END) THEN 0.32 ELSE 0 END + least(0.18, hits * 0.03))::DOUBLE, 6) AS strength FROM w WHERE n IS NOT NULL""")
def identity_evidence(t):
    k = F.col("doc_id")
    return t("documents").where(F.col("text").isNotNull()).select("doc_id", F.round(evidence.identity_strength((k % 5) / 4, F.when(k % 3 == 0, "Home").otherwise("That  THIS"), F.col("text")), 6).alias("strength"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(lower(url), '^https?://([^/?#]*)', 1) AS h FROM pages)
  SELECT page_id, h <> '' AS http, CASE page_id % 6 WHEN 0 THEN 'DST_PROGRAMME_PORTAL' WHEN 1 THEN 'IMPLEMENTING_AGENCY_PORTAL' WHEN 2 THEN 'OTHER_GOVERNMENT_PORTAL' WHEN 3 THEN 'GOVERNMENT_TECHNICAL_HOST' ELSE 'OTHER_EXTERNAL' END AS authority,
    CASE page_id % 6 WHEN 0 THEN 'DST' WHEN 3 THEN 'BIRAC' ELSE '' END AS source, page_id % 6 < 4 AS official, page_id % 6 = 5 AND h <> '' AS closed, page_id % 6 IN (2, 5) AS plausible FROM p""")
def address_checks(t):
    k = F.col("page_id") % 6
    host = rules.cascade([(k == 0, "www.nidhi.dst.gov.in"), (k == 1, "a.tdb.gov.in"), (k == 2, "x.gov.in/Apply"), (k == 3, "birac.nic.in")], "example.com")
    door = F.when(k == 5, "/login?x=1").otherwise("/a")
    own = t("pages").select("page_id", "url", F.concat(F.lit("HTTPS://"), host, door).alias("u"))
    http = U.is_http(F.col("url"))
    return own.select("page_id", http.alias("http"), U.authority(F.col("u")).alias("authority"), U.source_of(F.col("u")).alias("source"), U.official_for(F.lit("birac"), F.col("u")).alias("official"), (U.looks_closed(F.col("u"), F.lit("")) & http).alias("closed"), U.plausible_application(F.col("u")).alias("plausible"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN o_orderdate::DATE < DATE '1996-01-01' THEN 'CLOSED' ELSE 'ACTIVE' END WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'INACTIVE' WHEN 3 THEN 'HISTORICAL_OR_EXPIRED' WHEN 4 THEN 'REFERENCE' WHEN 5 THEN 'ACTIVE_OR_UNVERIFIED' ELSE 'UNKNOWN' END AS state,
  CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN o_orderdate::DATE < DATE '1996-01-01' THEN 0.95 ELSE 0.97 END WHEN 1 THEN 0.98 WHEN 2 THEN 0.85 WHEN 3 THEN 0.78 WHEN 4 THEN 0.7 WHEN 5 THEN 0.66 ELSE 0.35 END::DOUBLE AS confidence FROM orders""")
def lifecycles(t):
    k, before = F.col("o_orderkey") % 7, F.col("o_orderdate").cast("date") < F.lit(dt.date(1996, 1, 1))
    category = rules.cascade([(k.isin(0, 1, 5, 6), "CALL"), (k == 2, "PROGRAMME"), (k == 3, "FELLOWSHIP")], "POLICY")
    text = rules.cascade([(k == 0, F.when(before, F.lit("closes 5 May 2010")).otherwise("closes 6/7/2030")), (k == 2, "It was Withdrawn."), (k == 3, "of 2011"), (k == 5, "An open call.")], "")
    x = evidence.lifecycle(category, text, F.when(k == 1, "http://x/Archive"), F.when(k == 6, 4), F.lit(dt.date(2020, 1, 1)))
    return t("orders").select("o_orderkey", x.alias("x")).select("o_orderkey", "x.state", "x.confidence")
