"""The catalogue's queries, each an operator over the given tables, with the SQL that it equals.

Orders stand for applications and calls, parts for programmes, events for review items, pages for crawled pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, money, status
from ..functions import text as T
from ..functions import url as U
from ..operators import archive, dedupe, graph, match, merge, metrics, populations, rules, smart_match
from .registry import query

def _as_of():
    return F.lit("1998-09-02").cast("date")


def _status(c="o_orderstatus"):
    return F.when(F.col(c) == "O", "OPEN").when(F.col(c) == "P", "UPCOMING").otherwise("")


def _closing():
    return F.date_add(F.col("o_orderdate").cast("date"), 90)


def _bucket():
    return status.bucket(_status(), F.col("o_orderdate").cast("date"), _closing(), _as_of())


_BUCKET_SQL = """CASE WHEN o_orderdate::DATE + 90 < DATE '1998-09-02' THEN 'CLOSED' WHEN o_orderstatus = 'O' AND o_orderdate::DATE + 90 <= DATE '1998-09-02' + 30 THEN 'CLOSING_SOON'
  WHEN o_orderstatus = 'O' THEN 'OPEN' WHEN o_orderstatus = 'P' OR o_orderdate::DATE > DATE '1998-09-02' THEN 'UPCOMING' ELSE 'REFERENCE' END"""


@query(f"SELECT {_BUCKET_SQL} AS status_bucket, count(*) AS n FROM orders GROUP BY 1")
def status_coverage(t):
    return metrics.counter(t("orders"), _bucket(), "status_bucket")


@query("""SELECT CASE WHEN o_orderdate::DATE + 90 < DATE '1998-09-02' THEN 'CLOSED' WHEN o_orderdate::DATE > DATE '1998-09-02' THEN 'UPCOMING' WHEN o_orderdate IS NULL THEN 'STATUS_UNVERIFIED' ELSE 'OPEN' END AS call_status,
  o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""")
def call_status(t):
    own = t("orders").select(status.call_status(F.col("o_orderdate").cast("date"), _closing(), _as_of()).alias("call_status"), "o_orderpriority")
    return own.groupBy("call_status", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS records, count(DISTINCT nullif(trim(p_brand), '')) AS departments, count(DISTINCT nullif(trim(p_type), '')) AS sectors,
  count(*) FILTER (WHERE p_size > 25) AS large_records, min(p_retailprice) AS minimum_amount, max(p_retailprice) AS maximum_amount FROM part""")
def kpis(t):
    return t("part").agg(F.count(F.lit(1)).alias("records"), metrics.explicit_count(F.col("p_brand")).alias("departments"), metrics.explicit_count(F.col("p_type")).alias("sectors"), F.count_if(F.col("p_size") > 25).alias("large_records"), F.min("p_retailprice").alias("minimum_amount"), F.max("p_retailprice").alias("maximum_amount"))


@query("""SELECT l.level, coalesce(c.n, 0) AS n FROM (VALUES ('Central Government'), ('State Government'), ('Unspecified')) l(level) LEFT JOIN
  (SELECT CASE r_name WHEN 'ASIA' THEN 'Central Government' WHEN 'EUROPE' THEN 'State Government' ELSE 'Unspecified' END AS level, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) c USING (level)""")
def zero_filled_levels(t):
    own = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("scope", F.when(F.col("r_name") == "ASIA", "central").when(F.col("r_name") == "EUROPE", "State/UT").otherwise(""))
    return metrics.zero_filled(own, status.level(F.col("scope")), "level", status.LEVELS)


@query("""WITH x AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'Central Government' ELSE 'State Government' END AS level, unnest([lower(trim(p_name)), lower(trim(p_brand)), lower(trim(p_brand || '/' || p_size))]) AS name_key FROM part)
  SELECT name_key, min(level) AS level FROM x WHERE name_key <> '' GROUP BY name_key HAVING count(DISTINCT level) = 1""")
def scope_lookup(t):
    own = t("part").withColumn("level", F.when(F.col("p_size") % 2 == 0, status.LEVELS[0]).otherwise(status.LEVELS[1])).withColumn("own", F.concat("p_brand", F.lit("/"), F.col("p_size")))
    return metrics.scope_lookup(own, "level", ["p_name", "p_brand", "own"])


@query("""SELECT coalesce(nullif(trim(c_mktsegment), ''), nullif(trim(n_name), ''), 'Unspecified') AS label, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def coalesced_labels(t):
    own = t("orders").select("o_custkey").join(t("customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return metrics.counter(own, F.coalesce(T.first_value(F.col("c_mktsegment"), F.col("n_name")), F.lit("Unspecified")), "label")


@query("""SELECT w AS word, count(*) AS n FROM documents, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS x(w) WHERE trim(w) <> '' GROUP BY w""")
def flattened_counter(t):
    return metrics.flattened_counter(t("documents"), F.split(F.lower("text"), "[^a-z0-9]+"), "word")


@query("""SELECT count(*) FILTER (WHERE url LIKE 'https:%') AS secure, count(*) FILTER (WHERE contains(url, '?')) AS with_query, count(*) FILTER (WHERE regexp_matches(lower(url), '\\.html?([?#]|$)')) AS html_pages FROM pages""")
def resource_counts(t):
    u = F.col("url")
    return t("pages").agg(F.count_if(u.startswith("https:")).alias("secure"), F.count_if(U.part(u, 4) != "").alias("with_query"), F.count_if(U.ending(u).isin(".html", ".htm")).alias("html_pages"))


@query("""SELECT b.funding_bucket, coalesce(c.n, 0) AS n FROM (VALUES ('up_to_10_lakh'), ('10_lakh_to_1_crore'), ('1_crore_to_10_crore'), ('10_crore_to_50_crore'), ('above_50_crore'), ('not_specified')) b(funding_bucket) LEFT JOIN
  (SELECT CASE WHEN o_totalprice IS NULL THEN 'not_specified' WHEN o_totalprice * 100 <= 1000000 THEN 'up_to_10_lakh' WHEN o_totalprice * 100 <= 10000000 THEN '10_lakh_to_1_crore' WHEN o_totalprice * 100 <= 100000000 THEN '1_crore_to_10_crore'
   WHEN o_totalprice * 100 <= 500000000 THEN '10_crore_to_50_crore' ELSE 'above_50_crore' END AS funding_bucket, count(*) AS n FROM orders GROUP BY 1) c USING (funding_bucket)""")
def funding_buckets(t):
    return metrics.funding_buckets(t("orders"), F.col("o_totalprice") * 100)


@query("""WITH v AS (SELECT [x for x in [l_quantity, l_extendedprice, CASE WHEN l_discount > 0.05 THEN l_discount * 1000 END] if x IS NOT NULL] AS v FROM lineitem)
  SELECT * FROM (SELECT count(*) FILTER (WHERE len(v) > 0) AS records_with_funding, count(*) FILTER (WHERE len(v) = 0) AS records_missing_funding FROM v),
  (SELECT min(x) AS minimum_recorded_funding, max(x) AS maximum_recorded_funding, median(x) AS median_recorded_funding FROM (SELECT unnest(v) AS x FROM v))""")
def funding_summary(t):
    return metrics.funding_summary(t("lineitem"), F.array("l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0.05, F.col("l_discount") * 1000)))


@query("""SELECT p_partkey, s AS amount_text, CASE p_partkey % 5 WHEN 0 THEN p_size * 100000 WHEN 1 THEN CAST(trunc((p_size + 0.5) * 10000000) AS BIGINT) WHEN 2 THEN p_size * 1000 + 250 WHEN 3 THEN -1 ELSE p_size * 1000 END AS amount
  FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'Rs ' || p_size || ' lakh' WHEN 1 THEN p_size || '.5 crore' WHEN 2 THEN p_size || ',250' WHEN 3 THEN 'nan' ELSE p_size || ' kg' END AS s FROM part)""")
def parse_amount(t):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Rs "), size, F.lit(" lakh"))).when(k == 1, F.concat(size, F.lit(".5 crore"))).when(k == 2, F.concat(size, F.lit(",250"))).when(k == 3, "nan").otherwise(F.concat(size, F.lit(" kg")))
    return t("part").select("p_partkey", text.alias("amount_text"), F.coalesce(money.parse_amount(text), F.lit(-1)).alias("amount"))


@query("""SELECT label, complete, total, CAST(round_even(complete / total * 100, 0) AS INTEGER) AS percentage FROM (SELECT unnest(['Language', 'Long text', 'Quality label', 'Toxicity label']) AS label, unnest([a, b, c, d]) AS complete, total FROM
  (SELECT count(*) AS total, count(lang) AS a, count(*) FILTER (WHERE n_chars >= 1000) AS b, count(quality) AS c, count(*) FILTER (WHERE toxic = 1) AS d FROM documents LEFT JOIN labels USING (doc_id)))""")
def readiness(t):
    own = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id", "left")
    return metrics.readiness(own, {"Language": F.col("lang").isNotNull(), "Long text": F.col("n_chars") >= 1000, "Quality label": F.col("quality").isNotNull(), "Toxicity label": F.coalesce(F.col("toxic") == 1, F.lit(False))})


@query(f"""SELECT o_orderkey, {_BUCKET_SQL} AS status_bucket FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND {_BUCKET_SQL} NOT IN ('CLOSED', 'HISTORICAL') AND o_totalprice >= 50000 AND o_totalprice <= 400000 AND (o_orderdate IS NULL OR o_orderdate::DATE + 90 <= DATE '1999-12-31')""")
def filters(t):
    state = {"priority": ("1-URGENT", "2-HIGH"), "include_archived": False, "min_funding": 50_000, "max_funding": 400_000, "closing_to": "1999-12-31"}
    own = t("orders").withColumn("status_bucket", _bucket()).withColumn("closing", _closing())
    return smart_match.filtered(own, F.col("status_bucket"), state, facets={"priority": F.col("o_orderpriority")}, amounts=F.array("o_totalprice"), closing=F.col("closing")).select("o_orderkey", "status_bucket")


_PART_BUCKET_SQL = "CASE WHEN p_size <= 10 THEN 'OPEN' WHEN p_size <= 20 THEN 'UPCOMING' WHEN p_size <= 30 THEN 'VERIFICATION_REQUIRED' WHEN p_size <= 40 THEN 'CLOSED' ELSE 'REFERENCE' END"
_SCORED_SQL = f"""SELECT p_partkey, p_name, CASE b WHEN 'OPEN' THEN 15 WHEN 'UPCOMING' THEN 10 WHEN 'VERIFICATION_REQUIRED' THEN 5 ELSE 0 END + CASE WHEN lower(p_type) = 'standard' OR contains(lower(p_type), 'zzz') THEN 25 ELSE 0 END
  + CASE WHEN lower(p_brand) IN ('brand#11', 'brand#12') THEN 25 ELSE 0 END + CASE WHEN contains(lower(p_name), 'national') OR contains(lower(p_name), 'a') THEN 10 ELSE 0 END + CASE WHEN trunc(p_retailprice) >= 1200 THEN 5 ELSE 0 END AS score,
  array_to_string(list_sort([x FOR x IN [CASE WHEN lower(p_type) <> 'standard' THEN 'applicant type' END, CASE WHEN lower(p_brand) NOT IN ('brand#11', 'brand#12') THEN 'sector' END, CASE WHEN NOT (contains(lower(p_name), 'national') OR contains(lower(p_name), 'a')) THEN 'geographic scope' END, CASE WHEN trunc(p_retailprice) < 1200 THEN 'funding requirement' END] IF x IS NOT NULL]), ',') AS unmatched
  FROM (SELECT *, {_PART_BUCKET_SQL} AS b FROM part) WHERE b NOT IN ('CLOSED', 'HISTORICAL')"""


def _scored(t):
    size = F.col("p_size")
    b = rules.cascade([(size <= 10, "OPEN"), (size <= 20, "UPCOMING"), (size <= 30, "VERIFICATION_REQUIRED"), (size <= 40, "CLOSED")], "REFERENCE")
    profile = {"applicant_types": ["Standard"], "sectors": ["Brand#11", "Brand#12"], "geographic_scope": "a", "funding_requirement": 1200}
    return smart_match.score(t("part"), b, profile, applicants=F.array("p_type"), sectors=F.array("p_brand"), stages=F.array(), scope=F.col("p_name"), amounts=F.array(F.col("p_retailprice").cast("long"))).select("p_partkey", "p_name", "score", "unmatched")


@query(_SCORED_SQL)
def smart_match_scores(t):
    return _scored(t)


@query(f"SELECT p_partkey, score FROM ({_SCORED_SQL}) ORDER BY score DESC, lower(p_name || '#' || lpad(p_partkey::VARCHAR, 8, '0')) DESC LIMIT 10")
def smart_match_top(t):
    own = _scored(t).withColumn("name", F.concat("p_name", F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")))
    return smart_match.top(own, "name").select("p_partkey", "score")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_modes(t):
    top = t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    from pyspark.sql import Window

    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("position"))


def _listed(values) -> str:
    return "('" + "', '".join(values) + "')"


_RECORDS_SQL = """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'M' || (page_id % 200) END AS master_id,
    CASE page_id % 23 WHEN 0 THEN '' WHEN 1 THEN 'Schemes' WHEN 2 THEN 'plan.PDF' WHEN 3 THEN 'Growth%20Aid' WHEN 4 THEN '2021 sector report' WHEN 5 THEN 'site directory' WHEN 6 THEN 'Sitemap' ELSE 'Aid of ' || regexp_extract(url, '^https?://([^/?#]*)', 1) END AS scheme_name,
    CASE page_id % 7 WHEN 0 THEN 'APPLICATION_CALL' WHEN 1 THEN 'OTHER' WHEN 2 THEN '' WHEN 3 THEN 'challenge' WHEN 4 THEN 'REPORT' ELSE 'GRANT' END AS record_kind, CASE WHEN page_id % 29 = 0 THEN 'FUND' ELSE '' END AS normalized_record_kind,
    CASE WHEN page_id % 13 = 0 THEN '' ELSE 'dept' END AS ministry, CASE WHEN page_id % 39 = 0 THEN 'src' ELSE '' END AS source,
    CASE WHEN page_id % 17 = 0 THEN url || '/annual report' WHEN page_id % 19 = 0 THEN 'https://x.org/aid.PDF?v=1' WHEN page_id % 31 = 0 THEN '' ELSE url END AS official_page_url,
    CASE WHEN page_id % 5 = 0 THEN ' ; ' ELSE 'money' END AS benefits, CASE WHEN page_id % 37 = 0 THEN 'rejected' WHEN page_id % 3 = 0 THEN 'NEEDS_REVIEW' ELSE '' END AS current_decision, CASE WHEN page_id % 8 = 0 THEN 'Historical list' ELSE '' END AS catalogue_section FROM pages"""
_SIGNALS_SQL = " ".join(f"WHEN contains(x, '{s}') THEN 'EVIDENCE_SIGNAL_{s.upper().replace(' ', '_')}'" for s in populations.EVIDENCE_SIGNALS)


@query(f"""WITH r AS ({_RECORDS_SQL}), k AS (SELECT *, coalesce(nullif(normalized_record_kind, ''), nullif(record_kind, ''), 'SCHEME_OR_PROGRAMME') AS kind, url_decode(official_page_url) AS u, url_decode(scheme_name) AS n FROM r),
  f AS (SELECT *, lower(scheme_name || ' ' || u || ' ' || kind) AS x, lower(regexp_replace(regexp_replace(u, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '')) LIKE '%.pdf' AS pdf, ministry <> '' AS authority, trim(replace(benefits, ';', '')) <> '' AS core,
    CASE WHEN trim(n) = '' THEN 'MISSING_SCHEME_NAME' WHEN lower(trim(n)) IN {_listed(populations.GENERIC_NAMES)} THEN 'GENERIC_SCHEME_NAME' WHEN regexp_matches(lower(n), '[.](pdf|docx?|xlsx?)$') OR contains(scheme_name, '%') OR regexp_matches(lower(n), '^[0-9]{{4}} +[^|]+(report|ecosystem|landscape|trendbook|whitepaper)') THEN 'RAW_OR_URL_ENCODED_FILENAME_AS_NAME' WHEN contains(lower(n), 'sitemap') OR contains(lower(n), 'directory') THEN 'SITEMAP_OR_DIRECTORY_TITLE' ELSE '' END AS problem FROM k),
  e AS (SELECT *, CASE WHEN pdf AND regexp_matches(lower(scheme_name), '{'|'.join(populations.DOCUMENT_WORDS)}') THEN 'PDF_EXCEPTION_DENIED_REPORT_OR_GUIDANCE' WHEN pdf AND problem <> '' THEN 'PDF_EXCEPTION_DENIED_FILENAME_OR_GENERIC_NAME' WHEN pdf AND NOT authority THEN 'PDF_EXCEPTION_DENIED_AUTHORITY_MISSING' WHEN pdf AND NOT core THEN 'PDF_EXCEPTION_DENIED_CORE_FIELDS_MISSING'
    WHEN upper(kind) IN {_listed(populations.EVIDENCE_KINDS)} THEN 'EVIDENCE_ONLY_KIND_' || upper(kind) WHEN pdf THEN 'PDF_REQUIRES_FORMAL_EXCEPTION' {_SIGNALS_SQL} ELSE '' END AS evidence FROM f),
  o AS (SELECT *, CASE WHEN upper(current_decision) = 'REJECTED' THEN 'REJECTED_RECORD' WHEN upper(kind) IN {_listed(populations.CALL_KINDS)} THEN 'APPLICATION_CALL_SEPARATE' WHEN upper(kind) NOT IN {_listed(populations.MAIN_KINDS)} THEN 'INELIGIBLE_RECORD_KIND_' || upper(kind) WHEN problem <> '' THEN problem WHEN evidence <> '' THEN evidence WHEN NOT authority AND source = '' THEN 'AUTHORITY_OR_IMPLEMENTING_ORGANISATION_MISSING' WHEN official_page_url = '' THEN 'PRIMARY_OFFICIAL_URL_MISSING' ELSE 'MAIN_SCHEME_RECORD' END AS own FROM e),
  y AS (SELECT *, CASE WHEN master_id = '' THEN 'MISSING_MASTER_ID' WHEN page_id > min(page_id) FILTER (WHERE own = 'MAIN_SCHEME_RECORD') OVER (PARTITION BY master_id) THEN 'DUPLICATE_MASTER_ID' ELSE own END AS reason FROM o)
  SELECT page_id, reason, CASE WHEN reason = 'MAIN_SCHEME_RECORD' THEN 'MAIN' WHEN evidence <> '' OR problem IN ('RAW_OR_URL_ENCODED_FILENAME_AS_NAME', 'GENERIC_SCHEME_NAME', 'SITEMAP_OR_DIRECTORY_TITLE') THEN 'EVIDENCE' WHEN upper(kind) IN {_listed(populations.CALL_KINDS)} AND upper(current_decision) <> 'REJECTED' THEN 'CALL' ELSE 'EXCLUDED' END AS population,
    reason = 'MAIN_SCHEME_RECORD' AND catalogue_section = 'Historical list' AS is_archived, reason = 'MAIN_SCHEME_RECORD' AND current_decision = 'NEEDS_REVIEW' AS needs_verification FROM y""")
def population_split(t):
    k, url = F.col("page_id"), F.col("url")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    names = rules.cascade([(k % 23 == i, n) for i, n in enumerate(["", "Schemes", "plan.PDF", "Growth%20Aid", "2021 sector report", "site directory", "Sitemap"])], "*")
    own = t("pages").select(
        "page_id", F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("M"), (k % 200).cast("string"))).alias("master_id"), F.when(names == "*", F.concat(F.lit("Aid of "), host)).otherwise(names).alias("scheme_name"),
        rules.cascade([(k % 7 == i, n) for i, n in enumerate(["APPLICATION_CALL", "OTHER", "", "challenge", "REPORT"])], "GRANT").alias("record_kind"), F.when(k % 29 == 0, "FUND").otherwise("").alias("normalized_record_kind"),
        F.when(k % 13 == 0, "").otherwise("dept").alias("ministry"), F.when(k % 39 == 0, "src").otherwise("").alias("source"),
        F.when(k % 17 == 0, F.concat(url, F.lit("/annual report"))).when(k % 19 == 0, "https://x.org/aid.PDF?v=1").when(k % 31 == 0, "").otherwise(url).alias("official_page_url"),
        F.when(k % 5 == 0, " ; ").otherwise("money").alias("benefits"), F.when(k % 37 == 0, "rejected").when(k % 3 == 0, "NEEDS_REVIEW").otherwise("").alias("current_decision"), F.when(k % 8 == 0, "Historical list").otherwise("").alias("catalogue_section"),
    )
    return populations.split(own, "page_id").select("page_id", "reason", "population", "is_archived", "needs_verification")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'GRANT' WHEN p_partkey % 6 = 1 THEN 'FUND' WHEN p_partkey % 6 = 2 THEN 'CREDIT_OR_LOAN' WHEN p_partkey % 6 = 3 THEN 'OTHER_PROGRAMME_SUPPORT' WHEN p_partkey % 6 = 4 THEN 'SUPPORT_TYPE_NOT_SPECIFIED' ELSE 'PROCUREMENT_OR_MARKET_ACCESS' END AS support_type FROM part""")
def support_types(t):
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, "Grant in aid").when(k == 1, "seed fund").when(k == 2, "Credit guarantee").when(k == 3, "some programme").when(k == 4, "  ").otherwise("market access")
    return t("part").select("p_partkey", populations.support_type(raw).alias("support_type"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Healthcare & MedTech' WHEN 1 THEN 'Sector Not Specified' WHEN 2 THEN trim(p_type) ELSE 'Deep Technology' END AS sector FROM part""")
def sector_norm(t):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " HealthCare").when(k == 1, "N/A").when(k == 2, F.concat(F.lit("['"), "p_type", F.lit("']"))).otherwise("Science & Technology")
    return t("part").select("p_partkey", populations.sector(raw).alias("sector"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS norm_text FROM documents""")
def text_norm(t):
    return t("documents").select("doc_id", T.norm(F.col("text")).alias("norm_text"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' homepage.pdf'), '[^a-z0-9]+', ' ', 'g')) AS rough_key, k AS canonical_key, 'prg_' || substr(sha256(k || '|' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'))), 1, 20) AS stable_id
  FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' homepage.pdf'), '\\.pdf$', ''), '\\bhomepage\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM part)""")
def canonical_keys(t):
    name = F.concat("p_name", F.lit(" homepage.pdf"))
    return t("part").select("p_partkey", F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")).alias("rough_key"), T.canonical_key(name).alias("canonical_key"), T.stable_id("prg", name, F.col("p_brand")).alias("stable_id"))


_IGNORED_SQL = "('" + "', '".join(T.IGNORED_TOKENS) + "')"


def _tokens_sql(c: str) -> str:
    return f"list_sort(list_distinct([CASE WHEN ends_with(w, 's') AND length(w) > 4 THEN w[:-2] ELSE w END FOR w IN string_split_regex(lower(trim({c})), '[^a-z0-9]+') IF w <> '' AND w NOT IN {_IGNORED_SQL}]))"


@query(f"SELECT p_partkey, array_to_string({_tokens_sql('p_name')}, ' ') AS tokens FROM part")
def identity_tokens(t):
    return t("part").select("p_partkey", F.array_join(T.identity_tokens(F.col("p_name")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({_tokens_sql('text')}, ' ') AS tokens FROM documents")
def document_tokens(t):
    return t("documents").select("doc_id", F.array_join(T.identity_tokens(F.col("text")), " ").alias("tokens"))


@query(f"""WITH a AS (SELECT item_id, {_tokens_sql('text')} AS ta FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT doc_id, {_tokens_sql('line')} AS tb FROM l),
  ax AS (SELECT item_id, ta, unnest(ta) AS w FROM a), bx AS (SELECT doc_id, tb, unnest(tb) AS w FROM b),
  p AS (SELECT item_id, doc_id, ta, tb, count(*) AS k FROM ax JOIN bx USING (w) GROUP BY ALL)
  SELECT item_id, doc_id, max(k / (len(ta) + len(tb) - k)) AS similarity FROM p WHERE k / (len(ta) + len(tb) - k) >= 0.5 GROUP BY 1, 2""")
def token_similarity(t):
    a = t("benchmark").select("item_id", T.identity_tokens(F.col("text")).alias("ta"))
    b = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.identity_tokens(F.col("line")).alias("tb"))
    return match.similar_sets(a, "item_id", "ta", b, "doc_id", "tb", least=0.5)


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
  k AS (SELECT *, list_sort([x FOR x IN string_split(q, '&') IF x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|ref|source)(=|$)')]) AS kept FROM p)
  SELECT page_id, 'https://' || lower(host) || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS canonical_url FROM k""")
def url_canonical(t):
    return t("pages").select("page_id", U.canonical(F.col("url")).alias("canonical_url"))


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '([^/]*)$', 1) AS last FROM pages)
  SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS root, (ends_with(host, '.example.org') OR host = 'example.org') AS trusted,
  CASE WHEN NOT contains(last, '.') OR regexp_matches(last, '\.(html|htm|php|asp|aspx|jsp)$') THEN 'html' WHEN regexp_matches(last, '\.(pdf|docx?|xlsx?|pptx?)$') THEN 'document' ELSE 'asset' END AS kind FROM p""")
def url_facets(t):
    h = U.host(F.col("url"))
    return t("pages").select("page_id", h.alias("host"), U.root_domain(h).alias("root"), U.trusted(h, ["Example.org."]).alias("trusted"), U.kind(F.col("url")).alias("kind"))


@query(r"""SELECT page_id, len(u) AS n_urls, array_to_string(list_sort(u), ' ') AS urls FROM (SELECT page_id, list_distinct([regexp_replace(x, '[.,;]+$', '') FOR x IN regexp_extract_all(html, 'https?://[^\s"''<>()]+')]) AS u FROM pages)""")
def collect_urls(t):
    u = U.collect(F.col("html"))
    return t("pages").select("page_id", F.size(u).cast("long").alias("n_urls"), F.array_join(F.sort_array(u), " ").alias("urls"))


@query(r"""SELECT page_id, i - 1 AS ordinal, regexp_extract(x, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href FROM (SELECT page_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>') AS a FROM pages))""")
def html_links(t):
    return graph.links(t("pages")).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "href")


@query("""SELECT l_partkey, count(*) AS inbound_links, count(DISTINCT l_orderkey) AS inbound_sources FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1""")
def inbound_links(t):
    return graph.inbound(t("lineitem"), "l_orderkey", "l_partkey")


@query("""SELECT json_extract_string(props, '$.k') AS facet, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def json_facets(t):
    return t("events").groupBy(F.get_json_object("props", "$.k").alias("facet"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, priority FROM (SELECT event_id, value, ts, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS priority FROM events WHERE value > 1) ORDER BY priority, value DESC, event_id LIMIT 50""")
def review_list(t):
    p = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return t("events").where("value > 1").select("event_id", "value", p.alias("priority")).orderBy("priority", F.desc("value"), "event_id").limit(50).select("event_id", "priority")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2")
def status_report(t):
    return t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t):
    return dedupe.duplicates(t("events"), ["user_id", "event_type"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def dedupe_best(t):
    return dedupe.best_value(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("value"), -F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def dedupe_first(t):
    return dedupe.first_wins(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def dedupe_last_at_first(t):
    return dedupe.last_value_first_place(t("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY 1")
def latest_decision(t):
    own = t("events").where("event_type <> 'error'")
    return own.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-31' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR")
def fresh_cache(t):
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    return t("events").where((F.col("ts") <= as_of) & (F.col("ts") > as_of - F.expr("INTERVAL 24 HOUR"))).select("event_id")


@query("SELECT d.doc_id, f.first_id FROM documents d JOIN (SELECT text, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) f ON d.text = f.text WHERE d.doc_id > f.first_id")
def content_duplicates(t):
    return dedupe.content_duplicates(t("documents"), "text", "doc_id")


@query("""WITH h AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderpriority AS p, sha256(o_orderkey::VARCHAR) AS h FROM orders)
  SELECT o_orderkey FROM h QUALIFY row_number() OVER (PARTITION BY y ORDER BY h, o_orderkey) <= 3 OR row_number() OVER (PARTITION BY p ORDER BY h, o_orderkey) <= 3""")
def stratified_sample(t):
    own = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"))
    return dedupe.stratified_sample(own, "o_orderkey", ["y", "p"], 3)


_ASSESS_SQL = """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'OPEN' ELSE 'CLOSED' END ELSE 'UNKNOWN' END AS s, o_orderdate::DATE + 90 AS c, o_custkey || '|' || o_orderdate::DATE AS ident FROM orders),
  x AS (SELECT *, CASE WHEN s IN ('OPEN', 'UPCOMING') THEN 0 ELSE (s <> 'CLOSED')::INT + (c IS NULL)::INT + coalesce(c >= DATE '1998-09-02', false)::INT + (count(*) OVER (PARTITION BY ident) > 1)::INT END AS blockers FROM o)
  SELECT o_orderkey, year(c) AS closing_year, blockers, CASE WHEN s IN ('OPEN', 'UPCOMING') THEN 'CURRENT_EXCLUDED' WHEN blockers > 0 THEN 'EXCEPTION_REVIEW' WHEN o_orderpriority = '5-LOW' THEN 'QUALIFIED_WITH_WARNINGS' ELSE 'AUTO_QUALIFIED' END AS archive_state FROM x"""


def _assessed(t):
    own = t("orders").withColumn("s", F.when(F.col("o_orderstatus") == "F", "CLOSED").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 == 0), "OPEN").when(F.col("o_orderstatus") == "O", "CLOSED").otherwise("UNKNOWN")).withColumn("c", _closing())
    ident = F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("date").cast("string"))
    return archive.assess(own, F.col("s"), F.col("c"), _as_of(), ident, [F.col("o_orderpriority") == "5-LOW"], []).select("o_orderkey", F.year("c").alias("closing_year"), "blockers", "archive_state")


@query(_ASSESS_SQL)
def archive_assess(t):
    return _assessed(t)


@query(f"""SELECT closing_year, {', '.join(f"count(*) FILTER (WHERE archive_state = '{s}') AS {s.lower()}" for s in archive.STATES)} FROM ({_ASSESS_SQL}) WHERE closing_year IS NOT NULL GROUP BY 1""")
def year_pivot(t):
    return metrics.pivot_counts(_assessed(t), "closing_year", "archive_state", archive.STATES)


@query(f"""WITH a AS MATERIALIZED ({_ASSESS_SQL}), g AS (SELECT * FROM a WHERE archive_state IN ('AUTO_QUALIFIED', 'QUALIFIED_WITH_WARNINGS')),
  s AS (SELECT o_orderkey::VARCHAR AS k FROM g QUALIFY row_number() OVER (PARTITION BY closing_year ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey) <= 3),
  c AS (SELECT '{{' || string_agg('"' || archive_state || '":' || n, ',' ORDER BY archive_state) || '}}' AS states FROM (SELECT archive_state, count(*) AS n FROM a GROUP BY 1)),
  y AS (SELECT '{{' || coalesce(string_agg('"' || y || '":' || n, ',' ORDER BY y), '') || '}}' AS years FROM (SELECT closing_year::VARCHAR AS y, count(*) AS n FROM g GROUP BY 1)),
  i AS (SELECT '[' || coalesce(string_agg('"' || k || '"', ',' ORDER BY k), '') || ']' AS ids, count(*) AS n FROM s), t AS (SELECT count(*) AS total FROM a)
  SELECT total, states AS state_counts, years AS year_counts, i.n::INTEGER AS sample_size, sha256('{{"sample_ids":' || ids || ',"state_counts":' || states || ',"total":' || total || ',"year_counts":' || years || '}}') AS signature FROM c, y, i, t""")
def manifest_signature(t):
    own = _assessed(t)
    sample = dedupe.stratified_sample(own.where("archive_state like '%QUALIFIED%'"), "o_orderkey", ["closing_year"], 3)
    return archive.manifest(own, "archive_state", "closing_year", sample, "o_orderkey")


def _slices(t):
    c = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return c.where("c_custkey % 10 <> 0"), c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))


_DIFF_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'ADDED' WHEN c_custkey % 7 = 0 THEN 'REMOVED' WHEN c_custkey % 9 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS change FROM customer WHERE NOT (c_custkey % 10 = 0 AND c_custkey % 7 = 0)"""


@query(_DIFF_SQL)
def full_outer_diff(t):
    return merge.compare(*_slices(t), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query(f"""SELECT added, removed, changed, unchanged, round((added + removed + changed) * 100.0 / (removed + changed + unchanged), 4)::DOUBLE AS change_percent, round((added + removed + changed) * 100.0 / (removed + changed + unchanged), 4) <= 10 AS allowed
  FROM (SELECT count(*) FILTER (WHERE change = 'ADDED') AS added, count(*) FILTER (WHERE change = 'REMOVED') AS removed, count(*) FILTER (WHERE change = 'CHANGED') AS changed, count(*) FILTER (WHERE change = 'UNCHANGED') AS unchanged FROM ({_DIFF_SQL}))""")
def change_guard(t):
    return merge.change_guard(merge.compare(*_slices(t), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"]), 10)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'NEW' ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 5 = 0 THEN 'delta' ELSE 'base' END AS first_loaded FROM orders""")
def upsert_merge(t):
    o = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    base = o.where("o_orderkey % 5 <> 0").withColumn("first_loaded", F.lit("base"))
    delta = o.where("o_orderkey % 4 = 0 or o_orderkey % 5 = 0").withColumn("state", F.when(F.col("o_orderkey") % 4 == 0, "NEW").otherwise(F.col("state"))).withColumn("first_loaded", F.lit("delta"))
    return merge.upsert(base, delta, ["o_orderkey"], preserve=["first_loaded"])


@query("""SELECT c_custkey, CASE change WHEN 'UNCHANGED' THEN 'REUSED' WHEN 'REMOVED' THEN 'RETIRED' ELSE 'PROCESSED' END AS action FROM (""" + _DIFF_SQL + ")")
def incremental_reuse(t):
    return merge.reuse(*_slices(t), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query("""SELECT k AS o_orderkey, string_agg(n, ',' ORDER BY n) AS tables FROM (SELECT o_orderkey AS k, 'approved' AS n FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_orderkey, 'rejected' FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT o_orderkey, 'review' FROM orders WHERE o_orderkey % 5 = 0) GROUP BY k HAVING count(*) > 1""")
def input_overlap(t):
    o = t("orders").select("o_orderkey")
    return merge.overlap({"approved": o.where("o_orderkey % 2 = 0"), "review": o.where("o_orderkey % 5 = 0"), "rejected": o.where("o_orderkey % 3 = 0")}, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def protected_anti(t):
    return t("orders").select("o_orderkey").join(t("lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""SELECT source, category, count(*) AS n FROM (SELECT source, CASE WHEN l.doc_id IS NULL THEN 'NOT_LABELLED' WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 THEN 'APPROVED' ELSE 'REVIEW' END AS category FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1, 2""")
def coverage_summary(t):
    own = t("documents").select("doc_id", "source").join(t("labels").withColumn("known", F.lit(True)), "doc_id", "left")
    c = rules.cascade([(F.col("known").isNull(), "NOT_LABELLED"), (F.col("toxic") == 1, "REJECTED"), (F.col("quality") == 1, "APPROVED")], "REVIEW")
    return own.groupBy("source", c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, k AS slug, count(*) AS members, min(p_partkey) AS first_member, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types FROM (SELECT *, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '\\s+', '-', 'g') AS k FROM part) GROUP BY 1, 2""")
def consolidate(t):
    own = t("part").select("p_brand", T.slug(F.col("p_name")).alias("slug"), "p_partkey", "p_type")
    return own.groupBy("p_brand", "slug").agg(F.count(F.lit(1)).alias("members"), F.min("p_partkey").alias("first_member"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest FROM orders""")
def call_sequence(t):
    return graph.call_sequence(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("sequence").cast("long").alias("sequence"), "is_latest")


#: Phrases for the given texts, which are invented prose.
SECTORS = [{"sector": "Alpha", "strong": ["the and"], "weak": ["with", "from"], "negative": ["of"]}, {"sector": "Beta", "strong": ["que de"], "weak": ["los", "las"], "negative": ["la"]}, {"sector": "Gamma", "strong": ["der die"], "weak": ["und", "mit"], "negative": ["das"]}]


def _phrases_sql(s):
    n = lambda p, most, w: f"least(len(regexp_extract_all(x, '\\b{p}\\b')), {most}) * {w}"
    return " + ".join([*(n(p, 3, 8) for p in s["strong"]), *(n(p, 3, 2) for p in s["weak"]), *(n(p, 2, -5) for p in s["negative"])])


@query(f"""WITH d AS (SELECT doc_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS x FROM documents), s AS ({' UNION ALL '.join(f"SELECT doc_id, '{s['sector']}' AS sector, {_phrases_sql(s)} AS score FROM d" for s in SECTORS)})
  SELECT doc_id, sector, score::INTEGER AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sector) = 1""")
def sector_score(t):
    top = rules.sector_scores(T.low(F.col("text")), SECTORS)[0]
    return t("documents").select("doc_id", top.alias("x")).select("doc_id", "x.sector", "x.score")


@query("""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS x FROM documents),
  h AS (SELECT doc_id, contains(x, 'then')::INT + contains(x, 'that')::INT AS b, contains(x, 'with')::INT + contains(x, 'from')::INT + contains(x, 'ing')::INT AS a, contains(x, 'que')::INT AS n FROM d),
  s AS (SELECT *, greatest(0, least(100, least(60, b * 30) + least(40, a * 10) - n * 35)) AS score, CASE WHEN n > 0 AND b = 0 THEN 'RESEARCH_OR_INSTITUTION_ONLY' WHEN b > 0 AND a > 0 THEN 'DIRECT_OR_MEDIATED_STARTUP_SUPPORT' WHEN b > 0 THEN 'STARTUP_ECOSYSTEM_REFERENCE' ELSE 'RELEVANCE_REVIEW_REQUIRED' END AS classification FROM h)
  SELECT doc_id, classification, score, (score >= 70 AND classification = 'DIRECT_OR_MEDIATED_STARTUP_SUPPORT') AS publishable FROM s""")
def relevance(t):
    return t("documents").select("doc_id", rules.relevance(T.low(F.col("text")), ["then", "that"], ["with", "from", "ing"], ["que"]).alias("x")).select("doc_id", "x.*")


LINK_WEIGHTS = {"spam": -40, "blog": 10, "en/": 20, "example.org": 30, ".html": 15}


@query("SELECT page_id, greatest(0, least(100, " + " + ".join(f"CASE WHEN contains(lower(url), '{k}') THEN {w} ELSE 0 END" for k, w in LINK_WEIGHTS.items()) + ")) AS score FROM pages")
def link_score(t):
    return t("pages").select("page_id", rules.keyword_score(F.lower("url"), LINK_WEIGHTS).alias("score"))


ALIASES = [("red", "P1"), ("blue", "P2"), ("green", "P3"), ("small blue", "P4")]


@query("""WITH p AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x FROM part)
  SELECT p_partkey, CASE WHEN contains(x, ' small blue ') THEN 'P4' WHEN contains(x, ' green ') THEN 'P3' WHEN contains(x, ' blue ') THEN 'P2' WHEN contains(x, ' red ') THEN 'P1' ELSE '' END AS parent_id FROM p""")
def parent_resolve(t):
    return match.resolve_alias(t("part"), F.col("p_name"), ALIASES).select("p_partkey", "parent_id")


@query("""SELECT o_orderkey, array_to_string([strftime(d, '%Y-%m-%d') FOR d IN list_sort([o_orderdate::DATE, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + 10 END]) IF d IS NOT NULL AND year(d) >= 2000], ',') AS found FROM orders""")
def date_extract(t):
    d, e = F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 10)
    text = F.concat(F.lit("Opens "), F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMMM"), F.lit(", "), F.date_format(d, "yyyy"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" until "), F.date_format(e, "dd/MM/yyyy"))).otherwise(F.lit("")))
    return t("orders").select("o_orderkey", F.array_join(F.transform(dates.extract(text), lambda x: x.cast("string")), ",").alias("found"))


@query("SELECT conv_id, role, count(*) AS n, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1, 2")
def attribute_map(t):
    g = t("conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("turn")).alias("x"))
    return g.select("conv_id", "role", "n", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("turns"))


@query("WITH RECURSIVE r AS (SELECT p_partkey AS id, 0 AS level FROM part WHERE p_partkey <= 1 UNION ALL SELECT p.p_partkey, r.level + 1 FROM part p JOIN r ON p.p_partkey // 2 = r.id AND p.p_partkey > 1) SELECT id, level FROM r")
def tree_levels(t):
    nodes = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("long")).alias("parent"))
    return graph.tree_levels(nodes, "id", "parent")


@query(f"""WITH p AS (SELECT p_partkey, p_brand || '|' || array_to_string({_tokens_sql('p_name')}, ' ') AS k FROM part) SELECT k AS identity_key, count(*) AS members, min(p_partkey) AS leader FROM p GROUP BY 1 HAVING count(*) > 1""")
def semantic_match(t):
    g = match.semantic_groups(t("part"), F.col("p_name"), F.col("p_brand"))
    return g.groupBy("identity_key").agg(F.count(F.lit(1)).alias("members"), F.min("p_partkey").alias("leader")).where("members > 1")


@query()
def fuzzy_match(t):
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return match.fuzzy_match(names.select(F.col("id").alias("left_id"), F.col("p_name").alias("a")), names.select(F.col("id").alias("right_id"), F.col("p_name").alias("b")), "left_id", "a", "right_id", "b", least=0.6)


@query("SELECT user_id, max(value) AS value, min(event_id) AS event_id FROM events GROUP BY user_id ORDER BY max(value) DESC, min(event_id), user_id LIMIT 25")
def frontier_wave(t):
    return graph.frontier(t("events"), "user_id", "value", "event_id", 25)


_MOVES = [("O", "1-URGENT", "F"), ("O", "2-HIGH", "P"), ("P", "1-URGENT", "F")]


@query("""SELECT o_orderkey, coalesce(n, o_orderstatus) AS next_state, n IS NOT NULL AS is_allowed FROM orders LEFT JOIN (VALUES ('O', '1-URGENT', 'F'), ('O', '2-HIGH', 'P'), ('P', '1-URGENT', 'F')) m(s, a, n) ON s = o_orderstatus AND a = o_orderpriority""")
def state_machine(t):
    return merge.transition(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderpriority"), _MOVES).select("o_orderkey", "next_state", "is_allowed")


@query("""WITH e AS (SELECT event_id, event_type, value, user_id FROM events), c AS (SELECT event_id, (value > 10)::INT + (user_id IS NOT NULL)::INT + (event_type <> 'error')::INT AS passed FROM e)
  SELECT event_id, passed, CASE WHEN passed = 3 THEN 'READY' WHEN passed = 2 THEN 'NEEDS_REVIEW' ELSE 'BLOCKED' END AS assessment FROM c""")
def verification(t):
    passed = sum((F.when(c, 1).otherwise(0) for c in (F.col("value") > 10, F.col("user_id").isNotNull(), F.col("event_type") != "error")), F.lit(0))
    return t("events").select("event_id", passed.alias("passed")).withColumn("assessment", rules.cascade([(F.col("passed") == 3, "READY"), (F.col("passed") == 2, "NEEDS_REVIEW")], "BLOCKED"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def window_counts(t):
    from ..streaming import incremental

    out = incremental.window_counts(t("events"), "ts", ["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH d AS (SELECT doc_id, source, lang, CASE WHEN l.doc_id IS NULL THEN 'UNVERIFIED' WHEN toxic = 1 THEN 'QUARANTINE' WHEN n_chars < 200 THEN 'REVIEW' ELSE 'PUBLISH' END AS route, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents LEFT JOIN labels l USING (doc_id))
  SELECT route2 AS route, lang, count(*) AS n FROM (SELECT lang, CASE WHEN k > 1 THEN 'DUPLICATE' ELSE route END AS route2 FROM d) GROUP BY 1, 2""")
def governed_routes(t):
    own = t("documents").withColumn("digest", F.sha2("text", 256)).select("doc_id", "lang", "n_chars", "digest").join(t("labels").withColumn("known", F.lit(True)), "doc_id", "left")
    # the first of equal texts by a partial aggregate: copies of one text never meet in one task
    firsts = own.groupBy(F.col("digest").alias("same")).agg(F.min("doc_id").alias("first"))
    own = own.join(firsts, F.col("digest").eqNullSafe(F.col("same")))
    route = rules.cascade([(F.col("doc_id") != F.col("first"), "DUPLICATE"), (F.col("known").isNull(), "UNVERIFIED"), (F.col("toxic") == 1, "QUARANTINE"), (F.col("n_chars") < 200, "REVIEW")], "PUBLISH")
    return own.groupBy(route.alias("route"), "lang").agg(F.count(F.lit(1)).alias("n"))
