"""Queries of scores by many phrases, over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases as P
from .registry import query

#: By class: phrases, and those that veto it in a field. The classes are the documents' languages, by frequent words.
CLASSES = {
    "de": ("nicht und der die das ist ein eine mit auf für von dem den zu sch ung lich keit über sie wir aus bei nach".split(), ["lich der the"]),
    "en": ("the and of to that with this for from are was tion ing ment which have they been there when would could about other".split(), []),
    "es": ("que el los las del una por con para ción como más pero sus este entre cuando muy sin sobre también hasta hay donde".split(), ["ción del les"]),
    "fr": ("les des est une dans pour qui que sur pas avec plus par sont eau aux oux ment tion elle nous vous leur mais comme".split(), []),
}
WEIGHTS = {"line": 3.0, "body": 1.0}
VOCABULARY = {"nicht": 2.5, "the ": -1.0, "que": 0.5, "de la": 4.0, "tion": 1.0, "est": 0.25}
_LEAST, _LEAD = 4.0, 2.0


def _held(text: str, phrase: str) -> str:
    p = P.plain(phrase)
    return rf"regexp_matches({text}, '(^|[^\w\p{{L}}\p{{N}}]){p}($|[^\w\p{{L}}\p{{N}}])')" if len(p) <= 3 and p.isalpha() else f"contains({text}, '{p}')"


def _sum(terms) -> str:
    return " + ".join(f"({t})::INTEGER" for t in terms) or "0"


_NORM = "replace(lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"
_SCORES = ", ".join(
    "(" + " + ".join(f"CASE WHEN {' OR '.join(_held(f, v) for v in veto) or 'false'} THEN 0 ELSE {w} * least(3, {_sum(_held(f, p) for p in dict.fromkeys(own))}) END" for f, w in WEIGHTS.items()) + f")::DOUBLE AS {name}_"
    for name, (own, veto) in CLASSES.items()
)
_TEXTS = f"WITH d AS (SELECT doc_id, {_NORM.format('split_part(text, chr(10), 1)')} AS line, {_NORM.format('text')} AS body FROM documents)"


@query(f"""{_TEXTS}, s AS (SELECT doc_id, {_SCORES} FROM d), u AS (SELECT doc_id, unnest([{', '.join(f"{{'name': '{n}', 'score': {n}_}}" for n in CLASSES)}], recursive := true) FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS k FROM u WHERE score > 0), a AS (SELECT doc_id, max(name) FILTER (k = 1) AS best, max(score) FILTER (k = 1) AS top, max(name) FILTER (k = 2) AS second, max(score) FILTER (k = 2) AS next FROM r GROUP BY 1),
  o AS (SELECT doc_id, string_agg(name, ',' ORDER BY k) AS others FROM r JOIN a USING (doc_id) WHERE name <> best AND score >= greatest({_LEAST}, top * 0.5) GROUP BY 1)
  SELECT d.doc_id, CASE WHEN coalesce(top, 0) >= {_LEAST} THEN best ELSE 'none' END AS label, coalesce(top, 0) AS score, coalesce(second, '') AS runner_up, coalesce(top, 0) - coalesce(next, 0) AS lead,
    CASE WHEN top IS NULL THEN 'NO_EVIDENCE' WHEN top < {_LEAST} THEN 'WEAK_EVIDENCE' WHEN top - coalesce(next, 0) < {_LEAD} THEN 'CLOSE_RUNNER_UP' ELSE '' END AS flag, coalesce(others, '') AS others
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN o USING (doc_id)""")
def phrase_classes(t):
    phrases = P.Phrases(*[own for own, _ in CLASSES.values()], *[veto for _, veto in CLASSES.values()])
    texts = {"line": F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), "body": F.col("text")}
    held = t("documents").select("doc_id", *[phrases.held(P.normalised(c)).alias(n) for n, c in texts.items()])
    scored = held.select("doc_id", P.class_scores({n: (F.col(n), w) for n, w in WEIGHTS.items()}, CLASSES, phrases).alias("scores"))
    told = scored.select("doc_id", "scores", P.decision(F.col("scores"), least=_LEAST, margin=_LEAD, default="none").alias("d"))
    return told.select("doc_id", "d.label", "d.score", "d.runner_up", "d.lead", "d.flag", F.array_join(P.others(F.col("scores"), F.get("scores", F.lit(0))["name"], least=_LEAST, ratio=0.5, most=4), ",").alias("others"))


@query(f"""{_TEXTS} SELECT doc_id, ({' + '.join(f"CASE WHEN {_held('body', p)} THEN {w} ELSE 0 END" for p, w in VOCABULARY.items())})::DOUBLE AS score,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_held('body', p)} THEN '{p}' END" for p in VOCABULARY)}], lambda x: x IS NOT NULL), '|') AS matched FROM d""")
def dictionary_scores(t):
    phrases = P.Phrases(list(VOCABULARY))
    own = t("documents").select("doc_id", phrases.held(P.normalised(F.col("text"))).alias("held")).select("doc_id", P.dictionary_score(F.col("held"), VOCABULARY, phrases).alias("x"))
    return own.select("doc_id", "x.score", F.array_join("x.matched", "|").alias("matched"))
