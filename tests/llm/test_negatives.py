"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from tarnlake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, score double"


def brute(rows):
    """By the contract's words, over lists."""
    fine = [(k, [math.floor(256 * float(np.float32(x))) for x in v], c) for k, v, c in rows if k is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))  # noqa: E731, B905
    out = []
    for i, (k, v, c) in enumerate(fine):
        if k % 100:
            continue
        scored = sorted((-dot(v, w), j, d, n) for n, (j, w, d) in enumerate(fine) if n != i)
        for s, p, _, _ in [x for x in scored if x[2] == c][:5]:
            window = [x for x in scored if x[2] != c and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(k, p, r, j, -s, -t) for r, (t, j, _, _) in enumerate(window, 1)]
    return sorted(out)


def vectors(n, dims, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, dims))
    own = rng.integers(0, 6, n)
    return [(int(k), [float(np.float32(x)) for x in centres[c] + rng.normal(0, spread, dims)], int(c) if rng.random() < 0.9 else int(rng.integers(0, 6))) for k, c in zip(rng.permutation(n), own)]  # noqa: B905


@pytest.mark.parametrize(("seed", "dims", "block"), [(1, 16, 8192), (2, 7, 3)])
def test_mining_is_that_of_brute_force(spark, seed, dims, block):
    rows = vectors(1200, dims, seed)
    same = rows[3][1]
    rows += [(2000 + k, same, 1 + k % 2) for k in range(300)]  # one vector many times: ties by id
    rows += [rows[0], rows[5], (None, same, 1), (3000, None, 1), (3100, same, None), (3200, [None] + same[1:], 1), (3300, [math.nan] + same[1:], 2), (3400, [math.inf] + same[1:], 2), (3500, [], 1), (3600, same[:3], 1), (3700, [0.0] * dims, 2), (3800, [900.0] * dims, 2)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA).repartition(5)
    got = negatives.mine(df, "id % 100 = 0", draw=500, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(k, [float(np.float32(3e5 * (k + 1) / 7)), float(np.float32(1e5 / (k + 3)))] * 2, k % 2) for k in range(40)] + [(100, [3e5, 2e5] * 2, 0)]
    got = negatives.mine(spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA), "id % 100 = 0").collect()
    assert sorted(map(tuple, got)) == brute(rows) and got


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, "id % 100 = 0").count() == 0
    assert negatives.mine(spark.createDataFrame([(0, None, 1, "x", None)], SCHEMA), "id % 100 = 0").count() == 0
    assert negatives.mine(spark.createDataFrame([(0, [0.5, 0.5], 1, "x", None)], SCHEMA), "id % 100 = 0").count() == 0


def test_bounds_hold_and_leave_most_rows_out():
    rng = np.random.default_rng(7)
    rows = np.floor(256 * rng.normal(0, 0.125, (4000, 64)))
    books = negatives.codebooks(rows[:2000])
    codes, rest = negatives.encode(rows, books)
    anchors = {"ids": np.arange(8), "labels": np.zeros(8, np.int64), "chunks": np.full(8, -1), "places": np.zeros(8, np.int64), "vectors": rows[:8]}
    exact = rows @ rows[:8].T
    score, give = negatives.looked_up(negatives.tables(rows[:8], books), codes), rest[:, None] * np.sqrt((rows[:8] ** 2).sum(1))
    assert (np.abs(score - exact) <= give).all() and give.mean() < 0.15 * (rows[:8] ** 2).sum(1).mean()
    search = negatives.Search(anchors, np.full((8, 1), -np.inf), np.full((8, 1), np.inf), True, 5, books)
    search.see(0, np.arange(4000), np.zeros(4000, np.int64), rows, codes, rest)
    assert search.reranked < 0.1 * exact.size
    assert sorted(search.found[1].tolist()) == sorted(np.sort(exact, axis=0)[-5:].ravel().tolist())
