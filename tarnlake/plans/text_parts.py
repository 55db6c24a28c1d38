"""Queries of sections, lists and sentences, over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections as S
from .registry import query

_ALIASES, _TERMS = ("And ornd", "nicht aulich", "la des et"), ("thanedble", "nicht", " de ")
_HEADING = r"^[A-Z][A-Za-z ]{2,60}\.$"
_WS = r"trim(regexp_replace({0}, '[\s\x{{00a0}}\x{{0085}}]+', ' ', 'g'))"
_LINES = rf"d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r]'), lambda x: {_WS.format('x')}), lambda x: x <> '') AS ls, text FROM documents)"
_KEY = f"regexp_replace(translate(lower({{0}}), '{S._ACCENTED}', '{S._BARE}'), '[^a-z0-9]+', '', 'g')"
_NAMED = " OR ".join(f"contains({_KEY.format('x')}, '{S._key(a)}') OR contains('{S._key(a)}', {_KEY.format('x')})" for a in _ALIASES)
_LOW = "replace(lower({0}), 'ß', 'ss')"


def _holds(c: str) -> str:
    return "(" + " OR ".join(f"contains({_LOW.format(c)}, '{t}')" for t in _TERMS) + ")"


def _unique(rows: str) -> str:
    """Rows of (doc_id, i, v): the first of those equal but for case, joined."""
    return f"(SELECT doc_id, string_agg(v, '|' ORDER BY i) AS items, count(*) AS n FROM (SELECT doc_id, v, i, row_number() OVER (PARTITION BY doc_id, {_LOW.format('v')} ORDER BY i) AS r FROM {rows} WHERE v <> '') WHERE r = 1 GROUP BY 1)"


@query(f"""WITH {_LINES}, l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d),
  f AS (SELECT doc_id, min(i) AS i0 FROM l WHERE {_NAMED} GROUP BY 1),
  e AS (SELECT doc_id, min(i) AS i1 FROM l JOIN f USING (doc_id) WHERE i > i0 + 1 AND len(x) < 90 AND regexp_matches(x, '{_HEADING}') GROUP BY 1)
  SELECT doc_id, left(string_agg(x, ' ' ORDER BY i), 4000) AS section, count(*) AS n_lines FROM l JOIN f USING (doc_id) LEFT JOIN e USING (doc_id) WHERE i >= i0 AND i < coalesce(i1, 9000000000) GROUP BY 1""")
def text_sections(t):
    own = t("documents").select("doc_id", S.section_lines(F.col("text"), _ALIASES, _HEADING).alias("ls"), S.text_section(F.col("text"), _ALIASES, heading=_HEADING).alias("section"))
    return own.where(F.size("ls") > 0).select("doc_id", "section", F.size("ls").cast("long").alias("n_lines"))


@query(f"""WITH {_LINES}, u AS (SELECT doc_id, unnest(ls[2:]) AS v, generate_subscripts(ls[2:], 1) AS i FROM d WHERE len(ls) > 0 AND {_holds('ls[1]')}),
  u12 AS (SELECT doc_id, v, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM u WHERE len(v) >= 6),
  c AS (SELECT doc_id, string_split(regexp_replace({_WS.format("coalesce(text, '')")}, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM documents),
  n AS (SELECT doc_id, unnest(ss) AS v, generate_subscripts(ss, 1) AS i FROM c),
  n12 AS (SELECT doc_id, v, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM n WHERE len(v) >= 20 AND {_holds('v')})
  SELECT doc_id, CASE WHEN u.n > 0 THEN 'section-heading' WHEN n.n > 0 THEN 'keyword-context' ELSE 'none' END AS method, (CASE WHEN u.n > 0 THEN 0.9 WHEN n.n > 0 THEN 0.68 ELSE 0 END)::DOUBLE AS confidence, coalesce(u.n, n.n, 0) AS n, coalesce(u.items, n.items, '') AS items
  FROM documents LEFT JOIN {_unique('(SELECT * FROM u12 WHERE r <= 12)')} u USING (doc_id) LEFT JOIN {_unique('(SELECT * FROM n12 WHERE r <= 12)')} n USING (doc_id)""")
def section_evidence(t):
    d = t("documents").select("doc_id", "text", S.lines(F.col("text")).alias("ls"))
    sections = F.when(F.size("ls") > 0, F.create_map(F.get("ls", F.lit(0)), F.slice("ls", F.lit(2), F.size("ls"))))
    told = d.select("doc_id", S.section_matches(sections, F.col("text"), _TERMS).alias("m"))
    return told.select("doc_id", "m.method", "m.confidence", F.size("m.items").cast("long").alias("n"), F.array_join("m.items", "|").alias("items"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, unnest(flatten(list_transform(ls, lambda v: string_split_regex(v, '\\s*[•▪●]\\s*|\\s*;\\s*|\\s+[0-9]+[.)]\\s+')))) AS v, generate_subscripts(flatten(list_transform(ls, lambda v: string_split_regex(v, '\\s*[•▪●]\\s*|\\s*;\\s*|\\s+[0-9]+[.)]\\s+'))), 1) AS i FROM d),
  q AS (SELECT doc_id, i, regexp_replace({_WS.format('v')}, '^[ \\-–—:;]+|[ \\-–—:;]+$', '', 'g') AS v FROM p),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM q WHERE len(v) BETWEEN 12 AND 800)
  SELECT doc_id, coalesce(n, 0) AS n, coalesce(items, '') AS items FROM documents LEFT JOIN {_unique('(SELECT * FROM k WHERE r <= 12)')} USING (doc_id)""")
def list_entries(t):
    own = t("documents").select("doc_id", S.list_items(S.lines(F.col("text"))).alias("x"))
    return own.select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("items"))


@query(f"""WITH RECURSIVE {_LINES}, b AS (SELECT doc_id, list_filter(list_transform(ls, lambda v: regexp_replace(v, '^[ \\t\\r\\n•;:-]+|[ \\t\\r\\n•;:-]+$', '', 'g')), lambda v: len(v) >= 24 AND NOT regexp_full_match(v, '(?i)page\\s+\\d+\\s+of\\s+\\d+') AND len(v) - len(replace(v, '|', '')) < 3) AS ls FROM d),
  k AS (SELECT doc_id, list_filter(list_transform(ls, lambda v: {{'k': trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')), 'v': v}}), lambda x: x.k <> '') AS xs FROM b),
  f AS (SELECT doc_id, 0 AS i, []::STRUCT(k VARCHAR, v VARCHAR)[] AS kept FROM k UNION ALL
    SELECT doc_id, i + 1, CASE WHEN len(list_filter(kept, lambda y: y.k = xs[i + 1].k OR (len(y.k) > 35 AND len(xs[i + 1].k) > 35 AND (contains(y.k, xs[i + 1].k) OR contains(xs[i + 1].k, y.k))))) > 0 THEN kept ELSE list_append(kept, xs[i + 1]) END FROM f JOIN k USING (doc_id) WHERE i < len(xs))
  SELECT doc_id, len(kept) AS n, array_to_string(list_transform(kept, lambda x: x.v), '|') AS items FROM f JOIN k USING (doc_id) WHERE i = len(xs)""")
def distinct_texts(t):
    own = t("documents").select("doc_id", S.clean_texts(S.lines(F.col("text"))).alias("x"))
    return own.select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("items"))
