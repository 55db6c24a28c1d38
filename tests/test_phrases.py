"""One automaton against phrase by phrase."""

import random

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import phrases as P

TEXTS = [None, "", "  ", "AI (ai) main", "x ai_y", "Straße  und\nWeg", "seed fund seed", "SEED\tFUND!", "éa ai", "aié", "the fundings", "a" * 5000 + " ai " + "b" * 5000]


def words(rng):
    return [" ".join(rng.choice(["seed", "fund", "ai", "ml", "data", "grant", "é", "of"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]


def test_the_automaton_tells_what_each_phrase_does(spark):
    rng = random.Random(1)
    vocabulary = [*dict.fromkeys([*words(rng), "strasse und", "weg", "", " "])]
    phrases = P.Phrases(vocabulary)
    texts = TEXTS + [" ".join(rng.choice(["seed", "fund", "ai", "ml", "aids", "data", "grant", "of", "(of)", "É"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", P.normalised(F.col("text")).alias("t"))
    got = {r.id: list(r.held) for r in df.select("id", phrases.held(F.col("t")).alias("held")).collect()}
    some = list(phrases.numbers.items())
    for at in range(0, len(some), 60):
        part = some[at : at + 60]
        for r in df.select("id", *[P.contained(F.col("t"), p).alias(str(i)) for p, i in part]).collect():
            assert {i for _, i in part if r[str(i)]} == {i for _, i in part if i in got[r.id]}


@pytest.mark.parametrize("cap", [1, 3])
def test_scores_by_hand(spark, cap):
    classes = {"b": (["seed fund", "grant", "loan"], []), "a": (["grant", "data"], ["no data"]), "c": (["zzz"], [])}
    phrases = P.Phrases(*[x for own in classes.values() for x in own])
    df = spark.createDataFrame([(1, "grant", "seed fund and loan, grant"), (2, "no data", "data grant"), (3, None, "none"), (4, "grant", "")], "id long, title string, text string")
    held = df.select("id", *[phrases.held(P.normalised(F.col(c))).alias(c) for c in ("title", "text")])
    scores = P.class_scores({"title": (F.col("title"), 2.0), "text": (F.col("text"), 1.0)}, classes, phrases, cap=cap)
    got = {r.id: [tuple(x) for x in r.s] for r in held.select("id", scores.alias("s")).collect()}
    first = [("b", 5.0), ("a", 3.0)] if cap > 1 else [("a", 3.0), ("b", 3.0)]  # equal scores go by name
    assert got == {1: first, 2: [("a", float(min(cap, 2))), ("b", 1.0)] if cap > 1 else [("a", 1.0), ("b", 1.0)], 3: [], 4: [("a", 2.0), ("b", 2.0)]}
    told = {r.id: tuple(r.d) for r in held.select("id", P.decision(scores, least=2.0, margin=1.0, default="-").alias("d")).collect()}
    assert told[3] == ("-", 0.0, "", 0.0, "NO_EVIDENCE") and told[4] == ("a", 2.0, "b", 0.0, "CLOSE_RUNNER_UP")
