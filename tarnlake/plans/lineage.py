"""Queries of links, inheritance and counts by many sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, id_sets, lineage
from .registry import query

_LINKS = r"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\s[^>]*href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>)', 1)) AS x, generate_subscripts(regexp_extract_all(html, '(?is)(<a\s[^>]*href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>)', 1), 1) - 1 AS ordinal FROM pages),
  l AS (SELECT page_id, ordinal, regexp_extract(x, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace(regexp_replace(regexp_extract(x, '(?is)^<a\s[^>]*>(.*)</a>$', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS anchor FROM a)"""


@query(f"WITH {_LINKS} SELECT href, page_id, ordinal::INTEGER AS ordinal, anchor, (row_number() OVER (PARTITION BY href ORDER BY page_id, ordinal))::INTEGER AS rank FROM l QUALIFY rank <= 30")
def link_lineage(t):
    return lineage.reverse_links(graph.links(t("pages")), "href", ["page_id", "ordinal"]).select("href", "page_id", "ordinal", "anchor", "rank")


@query(f"WITH {_LINKS} SELECT href, count(*) AS occurrences, count(DISTINCT page_id) AS sources, count(DISTINCT nullif(anchor, '')) AS anchors, min(nullif(anchor, '')) AS first_anchor, count(DISTINCT page_id) >= 20 AS site_wide FROM l GROUP BY 1")
def link_contexts(t):
    return lineage.link_contexts(graph.links(t("pages")), "href", "page_id", "anchor", site_wide=20)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey - 1 - p_partkey % 3 END AS parent, CASE WHEN p_partkey % 10 = 0 THEN p_brand END AS family, (p_size % 50 + 50) / 100.0::DOUBLE AS confidence, (CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE 1 END) * p_partkey AS o, p_partkey % 13 <> 0 AS takes FROM part),
  w AS (SELECT id, o, family, confidence, 0 AS hops FROM p WHERE family IS NOT NULL UNION ALL
    SELECT p.id, p.o, w.family, w.confidence, hops + 1 FROM w JOIN p ON p.parent = w.id WHERE p.family IS NULL AND p.takes AND (hops = 0 OR w.o < p.o))
  SELECT p.id, coalesce(w.family, p.family) AS family, CASE WHEN hops > 0 THEN round(greatest(0.55, w.confidence - 0.1 * hops), 3) ELSE p.confidence END AS confidence, nullif(hops, 0) AS hops FROM p LEFT JOIN w ON w.id = p.id""")
def inherited_families(t):
    k = F.col("p_partkey")
    rows = t("part").select(k.alias("id"), F.when(k % 11 != 0, k - 1 - k % 3).alias("parent"), F.when(k % 10 == 0, F.col("p_brand")).alias("family"), ((F.col("p_size") % 50 + 50) / 100.0).alias("confidence"), (F.when(k % 4 == 0, -1).otherwise(1) * k).alias("o"), (k % 13 != 0).alias("takes"))
    return lineage.inherit(rows, "id", "parent", "family", "o", F.col("takes"), "confidence").select("id", "family", "confidence", F.col("inherited").alias("hops"))


_SETS = {"open": "o_orderstatus = 'O'", "closed": "o_orderstatus = 'F'", "verify": "o_orderstatus = 'P'", "urgent": "o_orderpriority = '1-URGENT'", "large": "o_totalprice > 300000"}
_NAMES = list(_SETS)


@query("WITH " + ", ".join(f"{n}_ AS (SELECT DISTINCT o_custkey FROM orders WHERE {c})" for n, c in _SETS.items()) + " " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n FROM {a}_ SEMI JOIN {b}_ USING (o_custkey)" for i, a in enumerate(_NAMES) for b in _NAMES[i:]))
def id_set_overlaps(t):
    return id_sets.overlaps(t("orders"), "o_custkey", {n: F.expr(c) for n, c in _SETS.items()})


_DIMENSIONS, _DECLARED = {"status": "o_orderstatus", "priority": "o_orderpriority", "year": "substr(cast(o_orderdate AS string), 1, 4)"}, {"status": ["P", "X", "O"]}


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c.replace('string', 'varchar')} AS value, count(*) AS n, NULL AS place FROM orders GROUP BY 2" for d, c in _DIMENSIONS.items()) + """ UNION ALL SELECT * FROM (VALUES ('status', 'P', 0, 0), ('status', 'X', 0, 1), ('status', 'O', 0, 2))),
  m AS (SELECT dimension, value, sum(n)::BIGINT AS n, min(place) AS place FROM c GROUP BY 1, 2) SELECT dimension, value, n, (row_number() OVER (PARTITION BY dimension ORDER BY place NULLS LAST, n DESC, value))::INTEGER AS position FROM m""")
def run_counters(t):
    return id_sets.counters(t("orders"), {d: F.expr(c) for d, c in _DIMENSIONS.items()}, _DECLARED)


@query("""WITH o AS (SELECT DISTINCT 'brand' AS field, p_brand AS option FROM part UNION SELECT 'word', unnest(string_split(p_name, ' ')) FROM part UNION SELECT 'type', p_type FROM part)
  SELECT field, option, (row_number() OVER (PARTITION BY field ORDER BY lower(option), option))::INTEGER AS position FROM o WHERE trim(option) <> ''""")
def facet_options(t):
    return id_sets.options(t("part"), {"brand": F.col("p_brand"), "word": F.split("p_name", " "), "type": F.col("p_type")})
