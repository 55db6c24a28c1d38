"""Similar token sets: the same pairs as all pairs, arrays worked out once, frequent words compared little."""

import random

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text
from tarnlake.operators import match


def frames(spark, a, b):
    return spark.createDataFrame(a, "i int, x array<string>").repartition(3), spark.createDataFrame(b, "j int, y array<string>").repartition(3)


def all_pairs(a, b, least):
    wanted = {}
    for i, x in a:
        for j, y in b:
            if x and y and (s := len(set(x) & set(y)) / len(set(x) | set(y))) >= least:
                wanted[i, j] = max(s, wanted.get((i, j), 0))
    return wanted


def counted(spark, c):
    """c, and how many rows it was worked out for."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def one(_):
        seen.add(1)
        return 0

    return one(c), seen


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_same_pairs_as_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    words = [f"w{k}" for k in range(40)] + ["é", "a" * 30, ""]
    weights = [40 / (k + 1) for k in range(len(words))]
    base = [rng.sample(words, k) for k in (1, 2, 3, 5, 8, 13, 21)]
    near = [[w for w in x if rng.random() < 0.85] + rng.sample(["new", "newer"], rng.randint(0, 2)) for x in base for _ in range(12)]
    other = [list(dict.fromkeys(rng.choices(words, weights, k=rng.randint(0, 12)))) for _ in range(80)]
    sets = near + other + base
    rng.shuffle(sets)
    a = [(k // 2, x) for k, x in enumerate(sets[:60])] + [(7, None), (8, [])]
    b = [(k // 2, x) for k, x in enumerate(sets[60:] + sets[:5] + sets[-5:] * 3)] + [(70, None), (71, ["elsewhere"])]
    l, r = frames(spark, a, b)
    got = {(x.i, x.j): x.similarity for x in match.similar_sets(l, "i", "x", r, "j", "y", least=least).collect()}
    wanted = all_pairs(a, b, least)
    assert wanted and got == pytest.approx(wanted)


def test_no_known_token_and_no_rows(spark):
    l, r = frames(spark, [(1, ["a", "b"])], [(1, ["c"]), (2, [])])
    assert match.similar_sets(l, "i", "x", r, "j", "y", least=0.5).collect() == []
    assert match.similar_sets(l.where("i > 1"), "i", "x", r, "j", "y", least=0.5).collect() == []
    assert match.similar_sets(l, "i", "x", r.where("j > 2"), "j", "y", least=0.5).collect() == []


def test_right_arrays_are_worked_out_once(spark):
    l, r = frames(spark, [(1, ["a", "b", "c"])], [(j, ["a", "b", f"t{j}"]) for j in range(50)])
    zero, seen = counted(spark, F.col("j"))
    r = r.withColumn("y", F.transform("y", lambda w: w)).withColumn("zero", zero).select("j", F.when(F.col("zero") == 0, F.col("y")).alias("y"))
    assert len(match.similar_sets(l, "i", "x", r, "j", "y", least=0.5).collect()) == 50
    assert seen.value == 50


def test_frequent_long_words_make_no_pairs(spark, monkeypatch):
    hot = ["notwithstanding", "administratively"]
    a = [(i, [*hot, *(f"l{i}x{k}" for k in range(4))]) for i in range(40)]
    b = [(j, [*hot, *(f"r{j}x{k}" for k in range(4))]) for j in range(60)] + [(100 + i, [*x[:5], "own"]) for i, x in a[:5]]
    l, r = frames(spark, a, b)
    own, seen = text.similarity, []

    def similarity(x, y):
        zero, n = counted(spark, F.size(x))
        seen.append(n)
        return own(x, y) + zero

    monkeypatch.setattr(match.T, "similarity", similarity)
    got = {(x.i, x.j): x.similarity for x in match.similar_sets(l, "i", "x", r, "j", "y", least=0.5).collect()}
    assert got == pytest.approx(all_pairs(a, b, 0.5)) and len(got) == 5
    assert sum(n.value for n in seen) < 100
