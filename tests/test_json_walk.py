"""JSON of any depth, against plain recursion over parsed values."""

import json
import random

from tarnlake.operators import json_walk

BLANKS = {"", "none", "nan", "nat", "null"}


def blank(v):
    return v is None or str(v).strip().lower() in BLANKS


def first_found(v, names):
    if isinstance(v, dict):
        for k, x in v.items():
            if k.lower() in names and not blank(x):
                return x
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        if not blank(found := first_found(x, names)):
            return found
    return None


def said(v):
    if isinstance(v, (dict, list)):
        for x in v.values() if isinstance(v, dict) else v:
            yield from said(x)
    elif t := " ".join(str(v or "").split()):
        yield t


def filled(base, more):
    out = dict(base)
    for k, x in more.items():
        if isinstance(out.get(k), dict) and isinstance(x, dict):
            out[k] = filled(out[k], x)
        elif k not in out or blank(out[k]):
            out[k] = x
    return out


def value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["x", " two  words ", "", "None", 0, 7, True, False, None, '{"name":1}', 'q"u\\o\nte', "é"])
    if kind < 0.7:
        return {rng.choice(["a", "b", "Name", "TITLE", "z\"", "é"]) + rng.choice(["", "1"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_walks_equal_recursion(spark):
    rng = random.Random(2)
    values = [value(rng, 6) for _ in range(150)]
    deep = {"name": "bottom"}
    for i in range(60):
        deep = {"k": deep} if i % 2 else [i, deep]
    values += [deep, {}, [], "plain", 5, None]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(1000, None), (1001, "no {json"), (1002, "")]
    df = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("text", "kind")
    found = {r.id: r.found for r in json_walk.deep_find(df, "id", "kind", ["NAME", "title"]).collect()}
    assert set(found) == set(range(len(values)))
    for i, v in enumerate(values):
        want = first_found(v, {"name", "title"})
        own = found[i]
        assert own == want or (own is not None and json.loads(own) == want if not isinstance(want, str) else False), (v, own, want)
    got = {}
    for r in sorted(json_walk.leaves(df, "id", "kind").collect(), key=lambda r: (r.id, r.path)):
        got.setdefault(r.id, []).append(r.text)
    assert got == {i: t for i, v in enumerate(values) if (t := list(said(v)))}
    assert json_walk.nodes(df.limit(0), "id", "kind").count() == 0


def test_merge_equals_recursion(spark):
    rng = random.Random(3)
    pairs = [(dict(v) if isinstance(v := value(rng, 4), dict) else {"a": v}, value(rng, 4)) for _ in range(150)]
    pairs += [({}, {}), ({"a": {}}, {"a": {}}), ({"a": {"b": {"c": None}}}, {"a": {"b": {"c": {"d": [1]}}}}), ({}, {"x": None}), ({"x": None}, {"x": None})]
    rows = [(i, json.dumps(a, ensure_ascii=False), json.dumps(b, ensure_ascii=False)) for i, (a, b) in enumerate(pairs)] + [(900, '{"a":1}', None), (901, None, '{"a":1}')]
    df = spark.createDataFrame(rows, "id long, b string, c string")
    got = {r.id: r.merged for r in json_walk.merge(df, "id", "b", "c").collect()}
    assert len(got) == len(rows) and got[900] == '{"a":1}' and got[901] is None
    for i, (a, b) in enumerate(pairs):
        want = filled(a, b) if isinstance(b, dict) else a
        assert json.loads(got[i]) == want and list(json.loads(got[i])) == list(want), (a, b)
