"""Queries of the wide record: parts as programmes, of a plan, staged rows, reviews, published rows and children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import wide_record
from .registry import query


def _sources(t) -> dict[str, DataFrame]:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    own = t("part").withColumn("master_id", F.concat(F.lit("P"), k)).withColumn("row", k).withColumn("named", F.concat_ws(" ", "p_name", F.expr("p_partkey div 40")))
    json = F.concat(
        F.lit('{"ministry":"M'), F.col("p_size"), F.lit('","department":" none ","nest":[{"x":1},{"department":"D '), F.col("p_brand"), F.lit('"}],"objectives":["'), F.col("p_name"), F.lit('","'),
        F.upper("p_name"), F.lit('",{"name":"'), F.col("p_type"), F.lit('"}],"record":{"deadline":"2024-01-0'), k % 9 + 1, F.lit('","ministry":"lost"}}'),
    )
    return {
        "plan": own.where(k % 10 != 9).select("master_id", "row", F.when(k % 2 == 0, F.col("named")).alias("scheme_name"), F.when(k % 3 == 0, F.col("p_brand")).alias("source"), F.when(k % 6 == 0, "closed calls").otherwise(none).alias("catalogue_section"),
            F.when(k % 7 == 0, "PENDING_REVALIDATION").otherwise("INCLUDED").alias("catalogue_inclusion"), F.when(k % 11 == 0, "rejected").alias("current_decision")),
        "data": own.where(k % 4 != 3).select("master_id", "row", F.concat_ws(" ", "named", "p_type").alias("scheme_name"), F.lit("staging").alias("source"), F.col("p_retailprice").alias("funding_max"), F.when(k % 5 != 0, json).alias("raw_record_json"), F.lit("1").alias("is_public")),
        "review": own.where(k % 3 == 0).select("master_id", "row", F.lit("review").alias("source"), F.lit("DST").alias("ministry"), F.when(k % 33 == 3, "REJECTED").alias("decision"), F.lit('["check","Check"]').alias("warnings_json")),
        "public": own.where((k % 10 == 9) | (k % 13 == 0)).select("master_id", "row", F.col("named").alias("scheme_name"), F.when(k % 20 == 19, "https://e.org/schemes").otherwise(F.concat(F.lit("https://e.org/x"), k)).alias("official_page_url"), F.when(k % 20 == 9, "Challenge").alias("record_kind")),
        "attributes": t("lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("master_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.lit("Eligibility").alias("name"), F.col("l_returnflag").alias("value")),
        "contacts": t("supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("master_id"), F.col("s_suppkey").alias("row"), F.when(F.col("s_suppkey") % 2 == 0, "desk").alias("kind"), F.col("s_name").alias("contact")),
    }


_NAMED = "p_name || ' ' || (p_partkey // 40)"
_RECORDS = f"""WITH p AS (SELECT *, p_partkey AS k, {_NAMED} AS named, p_partkey % 10 <> 9 AS planned, p_partkey % 4 <> 3 AS staged, p_partkey % 3 = 0 AS reviewed, p_partkey % 10 = 9 OR p_partkey % 13 = 0 AS published,
    CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 THEN 1 ELSE 0 END AS paid FROM part),
  q AS (SELECT *, CASE WHEN k % 11 = 0 THEN true WHEN k % 33 = 3 THEN true ELSE false END AS refused FROM p),
  i AS (SELECT *, planned AND ((staged AND NOT refused) OR k % 7 = 0 OR k % 6 = 0) AS kept FROM q),
  r AS (SELECT *, NOT kept AS added FROM i WHERE kept OR published),
  a AS (SELECT l_partkey AS k, string_agg(f, '/' ORDER BY pl) AS eligibility FROM (SELECT l_partkey, l_returnflag AS f, min(l_orderkey * 10 + l_linenumber) AS pl FROM lineitem GROUP BY 1, 2) GROUP BY 1),
  n AS (SELECT k, CASE WHEN added THEN named WHEN k % 2 = 0 THEN named WHEN staged THEN named || ' ' || p_type ELSE 'Unnamed record P' || k END AS scheme_name, CASE WHEN added AND k % 20 = 9 THEN 'CALL' ELSE 'SCHEME' END AS pop, CASE WHEN added THEN k + 1 ELSE 0 END AS pl FROM r),
  w AS (SELECT k, list_transform(list_filter(string_split_regex(lower(scheme_name), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: CASE WHEN x LIKE '%s' AND len(x) > 4 THEN x[:-2] ELSE x END) AS ws, pop, pl FROM n),
  g AS (SELECT k, list_sort(list_distinct(ws)) AS ws, pop, pl FROM w), m AS (SELECT ws, pop, max(pl) AS lst FROM g WHERE pl > 0 GROUP BY 1, 2), dir AS (SELECT k, pop, pl, unnest(ws) AS word FROM g WHERE pl > 0 AND k % 20 = 19), dm AS (SELECT pop, word, max(pl) AS lst FROM dir GROUP BY 1, 2),
  gone AS (SELECT k FROM g JOIN m USING (ws, pop) WHERE lst > pl UNION SELECT k FROM dir JOIN dm USING (pop, word) WHERE lst > pl)
  SELECT 'P' || r.k AS master_id, n.scheme_name,
    CASE WHEN added THEN CASE WHEN reviewed THEN 'review' ELSE '' END WHEN k % 3 = 0 THEN p_brand WHEN staged THEN 'staging' ELSE '' END AS source,
    CASE WHEN reviewed THEN 'DST' WHEN NOT added AND paid = 1 THEN 'M' || p_size ELSE '' END AS ministry,
    CASE WHEN NOT added AND paid = 1 THEN 'D ' || p_brand ELSE '' END AS department,
    CASE WHEN NOT added AND paid = 1 THEN '2024-01-0' || (k % 9 + 1) ELSE '' END AS closing_date,
    CASE WHEN NOT added AND staged THEN trunc(p_retailprice)::BIGINT::VARCHAR ELSE '' END AS funding_maximum,
    CASE WHEN NOT added AND paid = 1 THEN p_name || '/' || p_type ELSE '' END AS objectives,
    coalesce(a.eligibility, '') AS eligibility, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'desk: ' || s_name ELSE s_name END, '') AS contacts, CASE WHEN reviewed THEN 'check' ELSE '' END AS warnings,
    CASE WHEN added THEN '' WHEN k % 6 = 0 THEN 'CLOSED' WHEN k % 7 = 0 THEN 'STATUS_UNVERIFIED' ELSE '' END AS application_status,
    CASE WHEN added THEN 'APPROVED_FOR_DATABASE' WHEN k % 11 = 0 THEN 'rejected' WHEN k % 33 = 3 THEN 'REJECTED' ELSE '' END AS current_decision,
    CASE WHEN added OR staged THEN 1 ELSE 0 END AS is_public, CASE WHEN NOT added THEN '' WHEN k % 20 = 19 THEN 'https://e.org/schemes' ELSE 'https://e.org/x' || k END AS official_page_url
  FROM r JOIN n USING (k) LEFT JOIN a USING (k) LEFT JOIN supplier ON s_suppkey = k WHERE k NOT IN (SELECT k FROM gone)"""


@query(_RECORDS)
def catalogue_records(t):
    lists = ("objectives", "eligibility", "contacts", "warnings")
    own = wide_record.load(_sources(t))
    return own.select("master_id", "scheme_name", "source", "ministry", "department", "closing_date", F.coalesce(F.col("funding_maximum").cast("string"), F.lit("")).alias("funding_maximum"), *(F.array_join(c, "/").alias(c) for c in lists), "application_status", "current_decision", F.col("is_public").cast("int").alias("is_public"), "official_page_url")
