"""Repeated passages of words, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tarnlake.llm import automata, word_repeats

random.seed(11)
SCHEMA = "doc_id long, text string, chunk long, kind string"


def brute(rows, length):
    """By the contract's words: (id, words, removed, hash) of each row, in their order."""
    own = [t.encode().split() if t else [] for _, t in rows]
    seen = {}
    for n, ((k, _), ws) in enumerate(zip(rows, own, strict=True)):
        for i in range(len(ws) - length + 1):
            seen.setdefault(tuple(ws[i : i + length]), []).append((k, n, i))
    out = []
    for n, ((k, _), ws) in enumerate(zip(rows, own, strict=True)):
        gone = set()
        for i in range(len(ws) - length + 1):
            if any((m == n and j < i) or (m != n and k is not None and o is not None and o < k) for o, m, j in seen[tuple(ws[i : i + length])]):
                gone.update(range(i, i + length))
        out.append((k, len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return out


def prose(n, vocabulary=400):
    return [f"w{random.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    common, page = prose(60), prose(300)
    rows = [(k, " ".join(prose(random.choice([5, 30, 200])) + (common[random.randrange(20) :] if k % 3 == 0 else []) + prose(30) + (page[:150] if k % 7 == 0 else []))) for k in range(120)]
    rows += [(k, " ".join(page)) for k in (200, 150, 201, 202)]
    rows += [(300, " ".join(page[:40] * 4)), (None, " ".join(page[:40] * 3)), (None, " ".join(page)), (7, " ".join(prose(40) * 2)), (7, rows[7][1]), rows[9], rows[9]]
    return rows + [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, " ".join(["same"] * 500)), (405, " ".join(["same"] * 30)), (406, "漢字 é x " * 60), (407, "漢字 é x\n" * 60), (408, " ".join(prose(3) * 900)), (-5, " ".join(page[100:140]))]


@pytest.mark.parametrize(("length", "gram", "size", "part"), [(20, 10, 1 << 20, 1 << 18), (20, 10, 2000, 100), (6, 2, 3000, 1 << 18)])
def test_repeats_are_those_of_brute_force(spark, length, gram, size, part):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    got = word_repeats.remove_repeats(docs, length=length, gram=gram, size=size, part=part).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, length)))


def test_pieces_do_not_matter(monkeypatch):
    """Within a chunk, reference pieces of few places."""
    rows = corpus()
    chunk = word_repeats.Chunk.of([k for k, _ in rows], [t for _, t in rows])
    found = []
    for piece in (1 << 16, 50):
        monkeypatch.setattr(word_repeats, "PIECE", piece)
        at, anchor, window = chunk.windows(20, 10, 0)
        doc = np.searchsorted(chunk.ends, at, "right")
        claimed, covered = word_repeats._local(chunk, at, doc, *word_repeats._grouped(anchor, window), 20)
        assert sorted(at[claimed].tolist()) == sorted(covered.tolist())
        found.append(sorted(covered.tolist()))
    assert found[0] == found[1] and found[0]


def test_texts_and_no_rows(spark):
    words = prose(50)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a  b\n" + " ".join(words) + " c")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in word_repeats.remove_repeats(docs, with_text=True).collect()}
    assert got == {1: " ".join(words), 2: "a b c"}
    assert word_repeats.remove_repeats(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    words = prose(300_000, 5000)
    docs = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(words[1000:250_000])), (3, " ".join(words[-30:]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in word_repeats.remove_repeats(docs).collect()}
    assert got == {1: (249_000, 0), 2: (300_000, 249_000), 3: (30, 30)}


def test_hashes_alone_remove_nothing():
    with pytest.raises(ValueError, match="seed"):
        word_repeats._confirmed([([b"a"] * 5, 1, 0)], [([b"a"] * 4 + [b"b"], 2, 0)], 5)


@pytest.mark.parametrize("seed", range(4))
def test_automata_tell_earlier_starts(seed):
    rng = random.Random(seed)
    runs = [[rng.randrange(3) for _ in range(rng.randrange(4, 40))] for _ in range(12)]
    automaton, origin = automata.SuffixAutomaton(), []
    for k, run in enumerate(runs):
        automaton.add(run)
        origin += [k] * len(run)
    for own in (0, 3, 7, 12):
        streamed = [rng.randrange(4) for _ in range(200)]
        want = [i for i in range(len(streamed) - 3) if any(streamed[i : i + 4] == run[j : j + 4] for run in runs[:own] for j in range(len(run) - 3))]
        assert automaton.starts(streamed, 4, origin, own) == want
