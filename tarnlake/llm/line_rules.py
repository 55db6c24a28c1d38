"""Quality rules from line frequencies across documents, in DataFrame functions alone.

A document's lines are normalised (lower case, white space trimmed and runs of it made one space) and hashed with
its host. A line that stands in more than ``most_docs`` documents of its host is boilerplate there and is removed. A
document that keeps less than ``least_share`` of the characters of its different lines is depleted and rejected. Base rules
look at the document alone: too few words, or too many of them in repeated 8-word windows.

Null texts have no words and no lines: they fail the base rules. Null hosts are one host. Repeated rows count as documents
of their own. Hashes are of 64 bits. Counts are pre-aggregated before they are dealt out, so a line of any frequency is
one row a task; its join is one that Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

_WHITE = " \t\n\x0b\f\r"


def _repeats(words: str, n: int) -> Column:
    """Words inside n-word windows that occur twice or more in the array.

    Each step's array is bound as a lambda variable (a one-element array is transformed), so that it is made once. Windows
    are hashed; only if some are equal are they sorted with their places, and the places merged.
    """
    window = ", ".join(f"h[i + {k}]" for k in range(n))
    return F.expr(f"""
      transform(array(transform({words}, w -> xxhash64(w))), h ->
        transform(array(if(size(h) >= {n}, transform(sequence(0, size(h) - {n}), i -> xxhash64({window})), cast(array() as array<bigint>))), w ->
          if(size(array_distinct(w)) = size(w), 0L,
            transform(array(sort_array(transform(w, (x, i) -> struct(x as x, i as i)))), s ->
              transform(array(sort_array(transform(filter(s, (e, i) -> (i > 0 and s[i - 1].x = e.x) or (i + 1 < size(s) and s[i + 1].x = e.x)), e -> e.i))), p ->
                aggregate(transform(p, (v, i) -> if(i + 1 < size(p), least({n}, p[i + 1] - v), {n})), 0L, (a, b) -> a + b)
              )[0]
            )[0]
          )
        )[0]
      )[0]""")


def features(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(row, key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines): lines are (hash with host, characters), each different one once."""
    trimmed = F.expr(f"btrim(coalesce(`{text}`, ''), ' \\t\\n\\u000B\\f\\r')")
    split = docs.select(F.col(key), F.col(host).alias("__host"), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    normal = F.split(F.regexp_replace(F.lower("__text"), r"[\x20\x09\x0B-\x0D]+", " "), "\n")
    own = F.array_distinct(F.transform(F.filter(F.transform(normal, lambda x: F.btrim(x)), lambda x: x != ""), lambda x: F.struct(F.xxhash64(F.col("__host"), x).alias("h"), F.length(x).alias("n"))))
    return split.select(
        F.monotonically_increasing_id().alias("row"), F.col(key), F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", _WHITE, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        _repeats("__words", 8).alias("n_repeat_words"), own.alias("lines"),
    )


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", most_docs: int = 10, least_share: float = 0.5, least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, removed_chars, kept)."""
    of = store(features(docs, key=key, text=text, host=host), "line-features")
    each = of.select("row", F.explode("lines").alias("line")).select("row", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > most_docs).select("h")
    removed = each.join(common, "h").groupBy("row").agg(F.sum("n").alias("removed"))
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    out = of.select("row", key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), total.alias("line_chars")).join(removed, "row", "left")
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", F.coalesce("removed", F.lit(0)).cast("long").alias("removed_chars")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("line_chars") - F.col("removed_chars") >= least_share * F.col("line_chars"))
    )


#: The same over tables `documents`, as DuckDB reads it; with the defaults above and query op6's columns.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, list_slice(w, i, i + 7) AS x FROM d, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) >= 8),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
spans AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 8) - i) AS n FROM twice),
reps AS (SELECT r, sum(n) AS n FROM spans GROUP BY r),
ls AS (SELECT r, source, l FROM d, unnest(string_split(text, chr(10))) AS t(l)),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ls WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
norm AS (SELECT DISTINCT r, source, trim(regexp_replace(lower(l), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS l FROM ls),
kept_lines AS (SELECT r, source, l, count(*) OVER (PARTITION BY source, l) AS docs FROM norm WHERE l <> ''),
mass AS (SELECT r, sum(length(l)) AS total, coalesce(sum(length(l)) FILTER (WHERE docs > 10), 0) AS removed FROM kept_lines GROUP BY r),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words,
    coalesce(mass.total, 0)::BIGINT AS line_chars, coalesce(mass.removed, 0)::BIGINT AS removed_chars
  FROM d LEFT JOIN dup USING (r) LEFT JOIN reps USING (r) LEFT JOIN mass USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, removed_chars, (NOT base_failed AND line_chars - removed_chars >= 0.5 * line_chars) AS kept
FROM (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
"""
