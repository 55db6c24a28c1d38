"""Queries of the pages' structure. The SQL steps through the pieces of each page with a stack in a recursive table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import html as H
from .registry import query


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _is(s: str) -> str:
    if s[0] == "#":
        return f"regexp_extract(x, '(?is)\\sid\\s*=\\s*[\"'']?([^\\s>\"'']+)', 1) = '{s[1:]}'"
    if s[0] == ".":
        return f"list_contains(classes, '{s[1:]}')"
    if s[0] == "[":
        return f"regexp_extract(x, '(?is)\\srole\\s*=\\s*[\"'']?([^\\s>\"'']+)', 1) = '{s[6:-1]}'"
    return f"name = '{s}'"


_N = len(H.MAIN)
_UNESCAPED = "{0}"
for _name, _char in H._ENTITIES.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', chr({ord(_char)}))"
_PLAIN = rf"trim(regexp_replace({_UNESCAPED}, '[\s\x{{{{00a0}}}}]+', ' ', 'g'))"
_KEPT = "CASE WHEN {0} > d THEN 0 ELSE {0} END"


def _opened(field: str, case: str) -> str:
    own = _KEPT.format(field)
    return f"CASE WHEN ({own}) = 0 AND starts AND {case} THEN d ELSE {own} END AS {field}"


_PIECES = H.PIECES.replace("'", "''")
_UNITS = f"""WITH RECURSIVE t AS (SELECT page_id, unnest(regexp_extract_all(html, '{_PIECES}', 1)) AS x, unnest(range(len(regexp_extract_all(html, '{_PIECES}', 1)))) AS i FROM pages),
  n AS (SELECT *, lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS name, string_split_regex(regexp_extract(x, '(?is)\\sclass\\s*=\\s*["'']([^"'']*)', 1), '\\s+') AS classes FROM t),
  k AS (SELECT page_id, i, x, name, NOT starts_with(x, '<') OR x = '<' AS says, starts_with(x, '</') AS ends,
    starts_with(x, '<') AND NOT starts_with(x, '</') AND name NOT IN ('', 'script', 'style') AND NOT list_contains({_list(H.VOID)}, name) AND NOT ends_with(x, '/>') AS starts,
    [{', '.join(_is(s) for s in H.MAIN)}] AS mains, list_contains({_list(H.FRAME)}, name) OR list_has_any(classes, {_list(H.FRAME_CLASSES)}) AS framed FROM n),
  f AS (SELECT DISTINCT page_id, 0::BIGINT AS i, []::VARCHAR[] AS stack, 0 AS removed, 0 AS block, 0 AS block_at, 0 AS heading, 0 AS heading_at, 0 AS anchor, list_resize([]::INTEGER[], {_N}, 0) AS main, list_resize([]::INTEGER[], {_N + 1}, 0) AS frame, list_resize([]::INTEGER[], {_N}, 0) AS seen FROM pages
    UNION ALL
    SELECT page_id, i + 1, next, {_opened('removed', f'list_contains({_list(H.REMOVED)}, name)')}, nb, CASE WHEN nb = 0 THEN 0 WHEN ({_KEPT.format('block')}) = 0 THEN i + 1 ELSE block_at END,
      CASE WHEN heads THEN d ELSE {_KEPT.format('heading')} END, CASE WHEN heads THEN i + 1 WHEN ({_KEPT.format('heading')}) = 0 THEN 0 ELSE heading_at END, {_opened('anchor', "name = 'a'")},
      list_transform(range(1, {_N + 1}), lambda j: CASE WHEN seen[j] = 0 AND starts AND mains[j] THEN d WHEN main[j] > d THEN 0 ELSE main[j] END),
      list_transform(range(1, {_N + 2}), lambda j: CASE WHEN (frame[j] = 0 OR frame[j] > d) AND starts AND framed AND (j = {_N + 1} OR (main[j] > 0 AND main[j] <= d)) THEN d WHEN frame[j] > d THEN 0 ELSE frame[j] END),
      list_transform(range(1, {_N + 1}), lambda j: CASE WHEN starts AND mains[j] THEN 1 ELSE seen[j] END)
    FROM (SELECT *, CASE WHEN ({_KEPT.format('block')}) = 0 AND starts AND list_contains({_list(H.CONTENT)}, name) AND ({_KEPT.format('heading')}) = 0 THEN d ELSE {_KEPT.format('block')} END AS nb FROM (
      SELECT *, len(next) AS d, starts AND list_contains({_list(H.HEADINGS)}, name) AS heads FROM (
        SELECT f.*, k.name, k.starts, k.mains, k.framed, CASE WHEN k.starts THEN list_append(stack, name) WHEN k.ends AND list_contains(stack, name) THEN stack[:len(stack) - list_position(list_reverse(stack), name)] ELSE stack END AS next FROM f JOIN k USING (page_id, i))))),
  s AS (SELECT f.*, {_PLAIN.format('k.x')} AS own FROM f JOIN k USING (page_id, i) WHERE k.says AND removed = 0 AND trim(regexp_replace(k.x, '\\s+', ' ', 'g')) <> ''),
  z AS (SELECT page_id, [{', '.join(f'coalesce(sum(len(own) + 1) FILTER (main[{j}] > 0), 0) - 1' for j in range(1, _N + 1))}] AS sizes FROM s GROUP BY page_id),
  r AS (SELECT page_id, coalesce(list_position(list_transform(sizes, lambda v: v >= 120), true), 0) AS m FROM z),
  o AS (SELECT s.*, m, CASE WHEN m > 0 THEN main[m] ELSE -1 END AS depth FROM s JOIN r USING (page_id) WHERE CASE WHEN m > 0 THEN main[m] > 0 AND frame[m] = 0 ELSE frame[{_N + 1}] = 0 END),
  u AS (SELECT page_id, block_at AS place, false AS heads, i, own FROM o WHERE block > 0 AND block > depth UNION ALL SELECT page_id, heading_at, true, i, own FROM o WHERE heading > 0),
  b AS (SELECT page_id, place, heads, string_agg(own, ' ' ORDER BY i) AS said FROM u GROUP BY ALL),
  a AS (SELECT *, coalesce(last_value(CASE WHEN heads THEN said[:240] END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place), 'Overview') AS heading FROM b)"""


@query(f"""{_UNITS}, v AS (SELECT page_id, heading, CASE WHEN NOT heads AND len(said) >= 3 THEN said END AS said, min(place) AS place, bool_or(heads) AS named FROM a GROUP BY ALL)
  SELECT page_id, heading, count(said) AS n_texts, coalesce(sum(len(said[:5000])), 0)::BIGINT AS n_chars, md5(coalesce(string_agg(said[:5000], '|' ORDER BY place), '')) AS digest FROM v WHERE said IS NOT NULL OR named GROUP BY 1, 2""")
def page_sections(t):
    rows = H.page_structure(t("pages")).select("page_id", F.explode("sections").alias("heading", "v"))
    length = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    return rows.select("page_id", "heading", F.size("v").cast("long").alias("n_texts"), length.alias("n_chars"), F.md5(F.array_join("v", "|").cast("binary")).alias("digest"))


@query(f"""{_UNITS} SELECT p.page_id, {_PLAIN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")} AS title, CASE WHEN m > 0 THEN {_list(H.MAIN)}[m] ELSE 'body' END AS main,
    coalesce(round(sum(len(own)) FILTER (anchor > 0) / sum(len(own)), 6), 0) AS density, coalesce(sum(len(own)), 0)::BIGINT AS n_chars
  FROM pages p LEFT JOIN r USING (page_id) LEFT JOIN (SELECT page_id, own, anchor FROM o) USING (page_id) GROUP BY p.page_id, html, m""")
def page_main(t):
    parts = H.page_structure(t("pages"))
    return parts.select("page_id", "title", "main", F.round("link_density", 6).alias("density"), F.col("n_chars").cast("long").alias("n_chars"))
