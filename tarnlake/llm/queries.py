"""The subpackage's queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, cotraining, langid, line_rules, neardup, negatives, packing, postings, repeats, token_files, toxicity, url_rules, word_repeats
from .common import fold, table

#: (host, path, verdict): fixed values.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted", "n_passages")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer(), path := token_files.new_folder(spark))
    return token_files.checksums(token_files.read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_language_id, op5_token_ids, op6_quality_rules, op8_packing, op10_url_filters)}

_WINDOWS_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS x, least(len(w), 13) AS n FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
o AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT r, i, n, item_id FROM o JOIN p USING (x, n)),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
item AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(item.s, '')) AS items_sha256,
  (coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""

_URL_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
),
fits AS (
  SELECT u.r, rules.host || rules.path AS rule, verdict, row_number() OVER (PARTITION BY u.r ORDER BY length(rules.host || rules.path) DESC, rules.host || rules.path) AS k
  FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (r)
"""

SQL = {"op2_decontamination": _WINDOWS_SQL, "op6_quality_rules": line_rules.SQL, "op10_url_filters": _URL_SQL}


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


QUERIES["op4_near_duplicates"] = op4_near_duplicates

SQL["op4_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS x FROM d, unnest(range(1, greatest(2, len(w) - 2))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) c ON c.id = d.doc_id
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES["op9_suffix_dedup"] = op9_suffix_dedup


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return cotraining.score(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


QUERIES["op7_quality_classifier"] = op7_quality_classifier


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op13_token_alignment"] = op13_token_alignment


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, "id % 100 = 0")


QUERIES["op11_hard_negatives"] = op11_hard_negatives

SQL["op11_hard_negatives"] = r"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS other, b.vec_id AS id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r
),
p AS (SELECT anchor, anchor_id, other, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_repeats.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES["op12_substring_dedup"] = op12_substring_dedup

SQL["op12_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS x FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
f AS (SELECT x, min(doc_id) AS first FROM p GROUP BY x),
o AS (SELECT x, r, min(i) AS own FROM p GROUP BY x, r),
hit AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM p JOIN f USING (x) JOIN o USING (x, r) WHERE doc_id > first OR i > own),
n AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
k AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS s FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN hit USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
