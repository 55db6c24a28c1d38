"""Inheritance against a sequential loop; links, sets and counters on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import id_sets, lineage


def sequential(records):
    """The loop over the list: what a record has by then is what its children may take."""
    by_id = {r["id"]: r for r in records if r["id"] is not None}
    out = [dict(r) for r in records]
    now = {id(r): o for r, o in zip(records, out, strict=True)}
    for r, own in zip(records, out, strict=True):
        parent = by_id.get(r["parent"])
        parent = now[id(parent)] if parent else None
        if own["family"] is not None or parent is None or parent["family"] is None or not r["takes"]:
            continue
        own["family"], own["conf"] = parent["family"], round(max(0.55, (parent["conf"] or 0) - 0.1), 3)
    return {r["o"]: (r["family"], r["conf"]) for r in out}


def test_inheritance_equals_the_loop(spark):
    rng = random.Random(11)
    records = []
    for forest in range(6):
        n = 80
        shuffled = list(range(n))
        rng.shuffle(shuffled)
        for i in shuffled:
            parent = None if rng.random() < 0.1 else rng.randrange(max(0, i - 3), i + 1) if rng.random() < 0.9 else rng.randrange(n)
            records.append({"id": forest * 100 + i, "parent": None if parent is None else forest * 100 + parent, "family": f"f{i}" if rng.random() < 0.15 else None, "conf": round(rng.random(), 2) if rng.random() < 0.8 else None, "takes": rng.random() < 0.9})
    for i in range(200):  # a long chain in list order, then one against it
        records.append({"id": 1000 + i, "parent": 999 + i if i else None, "family": "head" if i == 0 else None, "conf": 0.99, "takes": True})
    for i in range(50):
        records.append({"id": 2000 + i, "parent": 2001 + i, "family": "tail" if i == 49 else None, "conf": 0.9, "takes": True})
    # a repeated id, an own parent, a circle, a missing parent, nulls
    odd = [(3000, None, "first", 0.9), (3000, None, None, 0.5), (3001, 3000, None, None), (3002, 3002, None, None), (3003, 3004, None, None), (3004, 3003, None, None), (3005, 9999, None, None), (None, 1000, None, None), (None, None, "x", None)]
    records += [{"id": i, "parent": p, "family": f, "conf": c, "takes": True} for i, p, f, c in odd]
    for o, r in enumerate(records):
        r["o"] = o
    df = spark.createDataFrame([(r["o"], r["id"], r["parent"], r["family"], r["conf"], r["takes"]) for r in records], "o long, id long, parent long, family string, conf double, takes boolean").withColumn("hops", F.lit("a column of the caller"))
    got = lineage.inherit(df, "id", "parent", "family", "o", F.col("takes"), "conf").collect()
    want = sequential(records)
    assert len(got) == len(records)
    for r in got:
        assert r.family == want[r.o][0], records[r.o]
        assert r.conf == (None if want[r.o][1] is None else pytest.approx(want[r.o][1], abs=1e-9)), records[r.o]


def test_inheritance_of_nothing(spark):
    df = spark.createDataFrame([], "o long, id long, parent long, family string, conf double, takes boolean")
    assert lineage.inherit(df, "id", "parent", "family", "o", F.col("takes"), "conf").count() == 0


def test_links_of_a_hot_target(spark):
    df = spark.range(20000).select(F.lit("hot").alias("t"), (F.col("id") % 7000).alias("s"), F.when(F.col("id") % 3 == 0, "").otherwise("go").alias("a")).unionByName(spark.createDataFrame([(None, 1, "x"), ("cold", None, None), ("cold", 5, "b")], "t string, s long, a string"))
    first = lineage.reverse_links(df, "t", ["s", "a"])
    expected = sorted(i % 7000 for i in range(20000))[:30]
    assert [r.s for r in first.where("t = 'hot'").orderBy("rank").collect()] == expected
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    got = {r.t: tuple(r)[1:] for r in lineage.link_contexts(df, "t", "s", "a").collect()}
    assert got == {"hot": (20000, 7000, 1, "go", True), "cold": (2, 1, 1, "b", False)}


def test_sets_and_counters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), (None, 1), ("c", None)], "k string, v int")
    got = {(r.left, r.right): r.n for r in id_sets.overlaps(df, "k", {"one": F.col("v") == 1, "two": F.col("v") == 2, "none": F.col("v") > 9}).collect()}
    assert got == {("one", "one"): 1, ("one", "two"): 1, ("one", "none"): 0, ("two", "two"): 2, ("two", "none"): 0, ("none", "none"): 0}
    counted = id_sets.counters(df, {"k": F.col("k"), "v": F.col("v")}, {"v": ["3", "2"]})
    assert sorted(map(tuple, counted.collect())) == [("k", "UNKNOWN", 1, 2), ("k", "a", 2, 1), ("k", "b", 1, 3), ("k", "c", 1, 4), ("v", "1", 2, 3), ("v", "2", 2, 2), ("v", "3", 0, 1), ("v", "UNKNOWN", 1, 4)]
    lists = spark.createDataFrame([(["b", " A", None, ""], "x"), (None, None), (["B"], " ")], "l array<string>, s string")
    assert sorted(map(tuple, id_sets.options(lists, {"l": F.col("l"), "s": F.col("s")}).collect())) == [("l", "A", 1), ("l", "B", 2), ("l", "b", 3), ("s", "x", 1)]
