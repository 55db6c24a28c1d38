"""Queries of classifiers, invariants, publication control and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, governance, graph, match
from .registry import query

ROLES = [("SUPPORTING_DOCUMENT", ["wh-x", "ation"]), ("CALL", ["call", "with"]), ("SCHEME", ["que", "los"]), ("PROGRAMME", ["und", "der"])]
_FOLDED = "replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def _word(x: str, *terms: str) -> str:
    return f"regexp_matches({x}, '\\b({'|'.join(terms)})\\b')"


@query(f"""SELECT doc_id, CASE WHEN {_word('x', 'spam')} THEN 'OTHER' WHEN contains(x, 'wh-x') OR {_word('x', 'ation')} THEN 'SUPPORTING_DOCUMENT' WHEN {_word('x', 'call', 'with')} THEN 'CALL' WHEN {_word('x', 'que', 'los')} THEN 'SCHEME' WHEN {_word('x', 'und', 'der')} THEN 'PROGRAMME' ELSE 'OTHER' END AS role FROM (SELECT doc_id, {_FOLDED} AS x FROM documents)""")
def record_roles(t):
    return t("documents").select("doc_id", classify.ordered(T.low(F.col("text")), ROLES, "OTHER", veto=["spam"]).alias("role"))


@query(f"""SELECT doc_id, array_to_string([n FOR n IN [CASE WHEN {_word('x', 'the', 'and')} THEN 'EN' END, CASE WHEN {_word('x', 'que', 'los')} THEN 'ES' END, CASE WHEN {_word('x', 'und')} THEN 'DE' END] IF n IS NOT NULL], ',') AS labels FROM (SELECT doc_id, {_FOLDED} AS x FROM documents)""")
def category_labels(t):
    own = classify.any_labels(T.low(F.col("text")), {"EN": ["the", "and"], "ES": ["que", "los"], "DE": ["und"]})
    return t("documents").select("doc_id", F.array_join(own, ",").alias("labels"))


@query(f"""SELECT doc_id, least(1.0, least(0.6, (contains(x, 'the')::INT + contains(x, 'ing')::INT + contains(x, 'ion')::INT) * 0.25) + least(0.5, (contains(x, 'que')::INT + contains(x, 'und')::INT) * 0.5))::DOUBLE AS evidence FROM (SELECT doc_id, {_FOLDED} AS x FROM documents)""")
def capped_evidence(t):
    return t("documents").select("doc_id", classify.capped(T.low(F.col("text")), [(["the", "ing", "ion"], 0.25, 0.6), (["que", "und"], 0.5, 0.5)]).alias("evidence"))


def _n(x: str, p: str, w: int) -> str:
    return f"least(len(regexp_extract_all({x}, '\\b{p}\\b')), 3) * {w}"


@query(f"""WITH d AS (SELECT doc_id, replace(lower(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'))), 'ß', 'ss') AS a, {_FOLDED} AS b FROM documents),
  s AS (SELECT doc_id, 0 AS r, 'English' AS n, {_n('a', 'the', 8)} + {_n('a', 'and', 8)} + {_n('b', 'the', 2)} + {_n('b', 'and', 2)} AS s FROM d UNION ALL SELECT doc_id, 1, 'German', {_n('a', 'und', 8)} + {_n('a', 'der', 8)} + {_n('b', 'und', 2)} + {_n('b', 'der', 2)} FROM d UNION ALL SELECT doc_id, 2, 'French', {_n('a', 'le', 8)} + {_n('a', 'les', 8)} + {_n('b', 'le', 2)} + {_n('b', 'les', 2)} FROM d),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, r) AS k FROM s), w AS (SELECT doc_id, max(n) FILTER (WHERE k = 1) AS n, max(s) FILTER (WHERE k = 1) AS s, max(s) FILTER (WHERE k = 2) AS s2 FROM k GROUP BY 1)
  SELECT doc_id, CASE WHEN s >= 10 AND s - s2 >= 4 THEN n ELSE 'REVIEW' END AS label, s::INTEGER AS score, s2::INTEGER AS runner_up FROM w""")
def weighted_sector(t):
    fields = {"title": (T.low(F.split_part("text", F.lit("\n"), F.lit(1))), 8), "body": (T.low(F.col("text")), 2)}
    got = classify.weighted_fields(fields, {"English": ["the", "and"], "German": ["und", "der"], "French": ["le", "les"]}, accept=10, margin=4, default="REVIEW")
    return t("documents").select("doc_id", got.alias("x")).select("doc_id", "x.*")


@query("""WITH c AS (SELECT o_orderkey, o_totalprice > 100000 AS a, o_orderstatus <> 'P' AS b, o_orderpriority <> '5-LOW' AS c FROM orders), s AS (SELECT o_orderkey, round((a::INT * 0.5 + b::INT * 0.3 + c::INT * 0.2), 3)::DOUBLE AS score, array_to_string([n FOR n IN [CASE WHEN NOT a THEN 'amount' END, CASE WHEN NOT c THEN 'priority' END, CASE WHEN NOT b THEN 'state' END] IF n IS NOT NULL], ',') AS failed FROM c)
  SELECT o_orderkey, score, failed, CASE WHEN score >= 0.82 THEN 'APPROVED' WHEN score >= 0.62 THEN 'REVIEW' ELSE 'REJECTED' END AS decision FROM s""")
def validation_checks(t):
    got = classify.checks({"amount": (F.col("o_totalprice") > 100_000, 0.5), "state": (F.col("o_orderstatus") != "P", 0.3), "priority": (F.col("o_orderpriority") != "5-LOW", 0.2)})
    own = t("orders").select("o_orderkey", got.alias("x")).select("o_orderkey", "x.score", F.array_join("x.failed", ",").alias("failed"))
    return own.withColumn("decision", classify.band(F.col("score"), [(0.62, "REVIEW"), (0.82, "APPROVED")], "REJECTED"))


@query("SELECT event_id, CASE WHEN value < 1 THEN 'REJECTED' WHEN event_type = 'view' THEN 'MORE_EVIDENCE' WHEN user_id % 7 = 0 THEN 'ADMIN_REVIEW' ELSE 'APPROVED' END AS decision FROM events")
def review_decision(t):
    return t("events").select("event_id", classify.decision(F.col("value") < 1, F.col("event_type") == "view", F.col("user_id") % 7 == 0).alias("decision"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate)::INTEGER ELSE -1 END AS found FROM orders")
def year_in_text(t):
    text = F.concat(F.lit("Call "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("x of "), F.date_format("o_orderdate", "yyyy"), F.lit("-closed"))
    return t("orders").select("o_orderkey", F.coalesce(classify.year_in(text), F.lit(-1)).alias("found"))


@query("""SELECT doc_id, len(e) AS n_emails, array_to_string(list_sort(e), ' ') AS emails FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{2,}')) AS e FROM documents)""")
def contacts(t):
    e = classify.emails(F.col("text"))
    return t("documents").select("doc_id", F.size(e).cast("long").alias("n_emails"), F.array_join(F.sort_array(e), " ").alias("emails"))


@query("""SELECT 'blank_ids' AS check, count(*) FILTER (WHERE o_orderkey IS NULL) AS failures FROM orders UNION ALL SELECT 'repeated_ids', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'outside_o_orderstatus', count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) FROM orders""")
def invariants(t):
    return governance.invariants(t("orders"), "o_orderkey", {"o_orderstatus": ["O", "F"]})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def orphan_references(t):
    return governance.orphans(t("lineitem"), "l_partkey", t("part").where("p_size > 5"), "p_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN o_custkey END, -1) AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def nulled_references(t):
    return governance.null_orphans(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"))


@query("SELECT count(*) FILTER (WHERE c_custkey % 10 = 0) AS missing, count(*) FILTER (WHERE c_custkey % 7 = 0) AS extra FROM customer WHERE NOT (c_custkey % 7 = 0 AND c_custkey % 10 = 0)")
def row_preservation(t):
    c = t("customer")
    return governance.same_rows(c.where("c_custkey % 7 <> 0"), c.where("c_custkey % 10 <> 0"), ["c_custkey", "c_name"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(quality::VARCHAR, 'none') ELSE lang END AS label FROM documents LEFT JOIN labels USING (doc_id)")
def fill_blank(t):
    own = t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "nan").otherwise(F.col("lang")).alias("label"))
    return governance.fill_blank(own, t("labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id", ["label"]).select("doc_id", F.coalesce("label", F.lit("none")).alias("label"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 3 <> 0")
def unapproved_removals(t):
    c = t("customer")
    return governance.protected_missing(c, c.where("c_custkey % 7 <> 0"), c.where("c_custkey % 3 = 0"), "c_custkey")


@query("""WITH w AS (SELECT o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'publish' ELSE 'withdraw' END AS action, CASE WHEN o_orderkey % 11 = 0 THEN 9 ELSE 1 END AS e FROM orders WHERE o_orderkey % 5 = 0)
  SELECT w.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'MISSING' WHEN e <> 1 THEN 'STALE' WHEN (o_orderstatus = 'O' AND action = 'publish') OR (o_orderstatus = 'F' AND action = 'withdraw') THEN 'MOVED' ELSE 'NOT_ALLOWED' END AS outcome FROM w LEFT JOIN orders o USING (o_orderkey)""")
def bulk_publication(t):
    o = t("orders")
    wanted = o.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 50 == 0, 100_000_000).otherwise(0)).alias("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "publish").otherwise("withdraw").alias("action"), F.when(F.col("o_orderkey") % 11 == 0, 9).otherwise(1).alias("expected_version"))
    rows = o.select("o_orderkey", F.col("o_orderstatus").alias("state"), F.lit(1).alias("version"))
    return governance.bulk_action(rows, wanted, "o_orderkey", state="state", version="version", allowed=[("O", "publish", "PUBLISHED", 1), ("F", "withdraw", "WITHDRAWN", 0)]).select("o_orderkey", "outcome")


@query("""SELECT o_orderkey, 'o_orderstatus' AS "column", o_orderstatus AS old_value, 'X' AS new_value FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, 'none' FROM orders WHERE o_orderkey % 6 = 0""")
def audit_rows(t):
    o = t("orders")
    after = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 6 == 0, "none").otherwise(F.col("o_orderpriority")))
    return governance.audit_rows(o, after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT p_partkey, f AS field, e AS evidence, sha256(e) AS digest FROM (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type']) AS f, unnest([trim(p_name), trim(p_brand), trim(p_type)]) AS e FROM part) WHERE e <> ''")
def evidence_rows(t):
    return governance.evidence_rows(t("part"), "p_partkey", ["p_name", "p_brand", "p_type"])


@query("SELECT 'programme' AS entity_type, p_partkey::VARCHAR AS id, p_name AS name FROM part UNION ALL SELECT 'call', o_orderkey::VARCHAR, 'none' FROM orders")
def tagged_union(t):
    own = governance.tagged_union({"programme": t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "call": t("orders").select(F.col("o_orderkey").alias("id"))}, ["id", "name"])
    return own.withColumn("name", F.coalesce("name", F.lit("none")))


@query("""SELECT 'lang' AS "column", count(*) AS "rows", count(*) FILTER (WHERE lang IS NULL) AS blanks, count(DISTINCT lang) AS distinct_values FROM documents UNION ALL SELECT 'source', count(*), count(*) FILTER (WHERE source IS NULL), count(DISTINCT source) FROM documents""")
def table_profile(t):
    return governance.profile(t("documents"), ["lang", "source"])


@query("SELECT lang AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 2)::DOUBLE AS percent FROM documents GROUP BY 1")
def composition(t):
    return governance.shares(t("documents"), "lang")


@query("""SELECT DISTINCT class_id AS left_id, p_partkey AS right_id FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS class_id FROM part WHERE p_name IS NOT NULL
  UNION ALL SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL) WHERE class_id <> p_partkey""")
def duplicate_candidates(t):
    """Pairs of each class's first part with its other members, for all parts; duplicate_classes tells the classes by key."""
    own = match.key_classes(t("part"), {"name": ["p_name"], "brand and size": ["p_brand", "p_size"]}, "p_partkey")
    return own.where("class_id <> p_partkey").select(F.col("class_id").alias("left_id"), F.col("p_partkey").alias("right_id")).distinct()


@query("""SELECT 'name' AS "key", p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS class_id, count(*) OVER (PARTITION BY p_name) AS members FROM part WHERE p_name IS NOT NULL QUALIFY members > 1
  UNION ALL SELECT 'brand and size', p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size), count(*) OVER (PARTITION BY p_brand, p_size) AS members FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL QUALIFY members > 1""")
def duplicate_classes(t):
    return match.key_classes(t("part"), {"name": ["p_name"], "brand and size": ["p_brand", "p_size"]}, "p_partkey")


@query(r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS x FROM pages), h AS (SELECT page_id, regexp_extract(x, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href FROM e)
  SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links, count(*) FILTER (WHERE href LIKE 'http%') AS absolute_links FROM h GROUP BY 1""")
def link_stats(t):
    own = graph.links(t("pages"))
    return own.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("distinct_links"), F.count_if(F.col("href").startswith("http")).alias("absolute_links"))
