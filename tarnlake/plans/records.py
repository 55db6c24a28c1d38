"""Queries of record building and of the match's explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records, rules, smart_match
from .registry import query

_PLAIN = "trim({0}, ' -*' || chr(9))"


@query(r"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_brand || '/' || p_type WHEN 1 THEN p_brand || '/' || p_type WHEN 2 THEN 'a/' || p_brand WHEN 3 THEN p_type WHEN 4 THEN 'size: ' || p_size || '; brand: ' || p_brand WHEN 5 THEN '' ELSE p_type || '/[odd' END AS listed,
  CASE p_partkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 5 THEN 0 WHEN 6 THEN 2 ELSE 1 END AS n FROM part""")
def list_cells(t):
    brand, kind = F.col("p_brand"), F.col("p_type")
    cells = [
        F.format_string('["%s", " %s", {"name": "%s", "url": "x"}, null]', brand, F.upper(brand), kind), F.concat(brand, F.lit(" ; "), kind, F.lit("| "), F.lower(kind), F.lit("\n- ")), F.format_string("['a', '%s']", brand),
        F.format_string('{"value": "nan", "title": "%s"}', kind), F.format_string('{"size": %s, "brand": "%s", "note": ""}', F.col("p_size").cast("string"), brand), F.lit("NaN"),
    ]
    cell = F.concat(kind, F.lit("; [odd"))
    for i, x in enumerate(cells):
        cell = F.when(F.col("p_partkey") % 7 == i, x).otherwise(cell)
    own = t("part").select("p_partkey", records.to_list(cell).alias("x"))
    return own.select("p_partkey", F.array_join("x", "/").alias("listed"), F.size("x").cast("int").alias("n"))


@query(f"""WITH r AS (SELECT conv_id, lower(role) AS grp, turn, {_PLAIN.format('trim(text)')} AS v FROM conversations WHERE trim(text) <> '' AND lower(trim(text)) NOT IN ('none', 'nan', 'nat', 'null')),
  d AS (SELECT conv_id, grp, v, turn FROM r WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, grp, replace(lower(v), 'ß', 'ss') ORDER BY turn, v) = 1)
  SELECT conv_id::VARCHAR AS conv_id, grp AS "group", count(*) AS n, sha256(string_agg(v, chr(31) ORDER BY turn, v)) AS digest FROM d GROUP BY 1, 2""")
def attribute_groups(t):
    own = records.attributes(t("conversations"), "conv_id", "role", "text", "turn").select("conv_id", F.explode("attributes").alias("group", "x"))
    return own.select("conv_id", "group", F.size("x").cast("long").alias("n"), F.sha2(F.array_join("x", "\x1f"), 256).alias("digest"))


@query("""WITH r AS (SELECT c_nationkey::VARCHAR AS c_nationkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'desk: ' || c_mktsegment END AS v FROM customer WHERE c_custkey % 10 <> 0),
  d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY c_nationkey, lower(v) ORDER BY c_custkey) = 1) SELECT c_nationkey, string_agg(v, '/' ORDER BY c_custkey) AS contacts FROM d GROUP BY 1""")
def contact_lists(t):
    k = F.col("c_custkey")
    own = t("customer").select("c_nationkey", "c_custkey", F.when(k % 3 == 0, " ").otherwise("desk").alias("kind"), F.when(k % 10 != 0, F.col("c_mktsegment")).alias("contact"))
    return records.contacts(own, "c_nationkey", "kind", "contact", "c_custkey").select("c_nationkey", F.array_join("contacts", "/").alias("contacts"))


_URL_SQL = r"""regexp_extract_all({0}, '(?i)https?://[^\s"<>\]\)'']+')"""


@query(f"""WITH c AS (SELECT page_id, 0 AS col, {_URL_SQL.format('url')} AS u FROM pages UNION ALL SELECT page_id, 1, {_URL_SQL.format('html')} FROM pages),
  x AS (SELECT page_id % 40 AS k, page_id, col, unnest(u) AS v, generate_subscripts(u, 1) AS i FROM c), s AS (SELECT k, page_id, col, i, trim(rtrim(v, '.,;'), ' -*' || chr(9)) AS v FROM x),
  d AS (SELECT * FROM s WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY k, lower(v) ORDER BY page_id, col, i) = 1)
  SELECT k::VARCHAR AS k, count(*) AS n, sha256(string_agg(v, ' ' ORDER BY page_id, col, i)) AS digest FROM d GROUP BY 1""")
def source_addresses(t):
    own = records.source_urls(t("pages").withColumn("k", F.col("page_id") % 40), "k", ["url", "html"], "page_id")
    return own.select("k", F.size("urls").cast("long").alias("n"), F.sha2(F.array_join("urls", " "), 256).alias("digest"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Healthcare & MedTech' WHEN 1 THEN p_type ELSE 'Sector Not Specified' END AS sector, CASE p_partkey % 3 WHEN 0 THEN p_type || '/Deep Technology' ELSE '' END AS others,
  CASE p_partkey % 3 WHEN 0 THEN 'GRANT' WHEN 1 THEN 'CREDIT_OR_LOAN' ELSE 'OTHER_PROGRAMME_SUPPORT' END AS support, CASE p_partkey % 3 WHEN 0 THEN 'FUND' ELSE '' END AS more FROM part""")
def sectors_and_support(t):
    k, kind = F.col("p_partkey") % 3, F.col("p_type")
    sectors, sector = F.when(k == 0, F.concat(F.lit("healthcare; "), kind, F.lit(" | science & technology"))).otherwise(" ; "), F.when(k == 1, kind)
    types, of = F.when(k == 0, F.lit("grant in aid;seed fund")), F.when(k == 1, F.lit("CREDIT_GUARANTEE"))
    return t("part").select("p_partkey", records.primary_sector(sectors, sector).alias("sector"), F.array_join(records.secondary_sectors(sectors, sector), "/").alias("others"), records.primary_support_type(types, of).alias("support"), F.array_join(records.secondary_support_types(types), "/").alias("more")).withColumn("more", F.coalesce("more", F.lit("")))


@query("SELECT 'Deep Technology' AS sector, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS n UNION ALL SELECT 'Sector Not Specified', (SELECT count(*) FROM part WHERE p_partkey % 2 = 1)")
def sector_counts(t):
    return t("part").groupBy(records.primary_sector(F.when(F.col("p_partkey") % 2 == 0, F.lit("Science & Technology; x")), F.lit(None).cast("string")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '/late' WHEN event_type = 'late' THEN 'late' ELSE event_type || '/late' END AS reasons FROM events""")
def merged_reasons(t):
    a = F.when(F.col("event_id") % 2 == 0, F.array(F.col("event_type"), F.lit(" "), F.concat(F.col("event_type"), F.lit(" "))))
    return t("events").select("event_id", F.array_join(records.merge_reasons(a, F.array(F.when(F.col("event_id") % 2 == 1, F.col("event_type")).otherwise(""), F.lit("late"))), "/").alias("reasons"))


@query("SELECT user_id::VARCHAR AS user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def last_records(t):
    return records.last_rows(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id").withColumn("user_id", F.col("user_id").cast("string"))


@query("""WITH p AS (SELECT *, CASE WHEN p_size <= 10 THEN 'OPEN' WHEN p_size <= 20 THEN 'UPCOMING' WHEN p_size <= 30 THEN 'VERIFICATION_REQUIRED' WHEN p_size <= 40 THEN 'CLOSED' ELSE 'REFERENCE' END AS b, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS s, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN 'Nationally' ELSE p_name END AS g, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice::BIGINT END AS f FROM part),
  q AS (SELECT *, lower(s) IN ('brand#11', 'brand#12') AS ms, contains(lower(g), 'red') OR contains(lower(g), 'national') AS mg FROM p)
  SELECT p_partkey, (CASE b WHEN 'OPEN' THEN 15 WHEN 'UPCOMING' THEN 10 WHEN 'VERIFICATION_REQUIRED' THEN 5 ELSE 0 END + CASE WHEN ms THEN 25 ELSE 0 END + CASE WHEN g <> '' AND mg THEN 10 ELSE 0 END + CASE WHEN f >= 1200 THEN 5 ELSE 0 END)::INTEGER AS score,
    array_to_string([x FOR x IN [CASE WHEN b IN ('OPEN', 'UPCOMING') THEN 'application status' END, CASE WHEN f >= 1200 THEN 'funding requirement' END, CASE WHEN g <> '' AND mg THEN 'geographic scope' END, CASE WHEN ms THEN 'sector' END] IF x IS NOT NULL], ',') AS matched,
    array_to_string([x FOR x IN [CASE WHEN b = 'CLOSED' THEN 'application status' END, CASE WHEN f < 1200 THEN 'funding requirement' END, CASE WHEN g <> '' AND NOT mg THEN 'geographic scope' END, CASE WHEN NOT ms THEN 'sector' END] IF x IS NOT NULL], ',') AS unmatched,
    array_to_string([x FOR x IN [CASE WHEN b = 'VERIFICATION_REQUIRED' THEN 'Application status requires verification before acting.' END, CASE WHEN g = '' THEN 'Geographic scope data is missing for this record.' END, CASE WHEN f IS NULL THEN 'Structured funding data is missing for this record.' END, CASE WHEN s = '' THEN 'sector data is missing for this record.' END] IF x IS NOT NULL], ',') AS warnings,
    CASE WHEN b IN ('OPEN', 'UPCOMING', 'CLOSED') OR ms OR (g <> '' AND mg) OR f >= 1200 THEN (b IN ('OPEN', 'UPCOMING', 'CLOSED'))::INTEGER + ms::INTEGER + (g <> '' AND mg)::INTEGER + coalesce(f >= 1200, false)::INTEGER ELSE 1 END AS n_reasons,
    b NOT IN ('OPEN', 'UPCOMING', 'CLOSED') AND NOT ms AND NOT (g <> '' AND mg) AND NOT coalesce(f >= 1200, false) AS without_match FROM q""")
def match_explanations(t):
    size, k = F.col("p_size"), F.col("p_partkey")
    b = rules.cascade([(size <= 10, "OPEN"), (size <= 20, "UPCOMING"), (size <= 30, "VERIFICATION_REQUIRED"), (size <= 40, "CLOSED")], "REFERENCE")
    profile = {"sectors": ["Brand#11", " brand#12 "], "geographic_scope": "Red", "funding_requirement": 1200}
    scope = F.when(k % 5 == 0, "").when(k % 5 == 1, "Nationally").otherwise(F.col("p_name"))
    amounts = F.when(k % 3 == 0, F.array().cast("array<long>")).otherwise(F.array(F.col("p_retailprice").cast("decimal(20,0)").cast("long")))
    got = smart_match.explain(b, profile, applicants=F.array(), sectors=F.array(F.when(k % 4 == 0, " ").otherwise(F.col("p_brand"))), stages=F.array(), scope=scope, amounts=amounts)
    own = t("part").select("p_partkey", got.alias("x"))
    lists = [F.array_join(f"x.{n}", ",").alias(n) for n in ("matched", "unmatched", "warnings")]
    return own.select("p_partkey", "x.score", *lists, F.size("x.reasons").alias("n_reasons"), F.array_contains("x.reasons", smart_match.NO_MATCH).alias("without_match"))
