"""Alignment of two tokenizers, against a plain count over all tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from tarnlake.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
random.seed(5)
PLAIN = "the quick brown fox isn't over 1234 lazy-dogs; naïve façade 漢字 😀 antidisestablishmentarianism".split()
TEXTS = [
    None, "", " ", "  ", "\n", "a", " lead", "trail \n", "two  blanks   three", "x\n\ny\n z\t\tq \n  w", "under▁score", "<s> </s> <unk> <0x41> <|endoftext|> a<|endoftext|>", "nb sp 　 wide line \x1c sep\x85 next", "é ﻿​ \x00 \x01", "'s we'll  don't",
    "漢字かな交じり文" * 30, "x" * 5000, *[" ".join(random.choice(PLAIN) for _ in range(random.choice([3, 40, 400]))) for _ in range(30)], *["".join(random.choice([" ", "\n", "ab", "é", ".", "9", "\t", " ", "’s"]) for _ in range(60)) for _ in range(60)],
]


def plain(texts):
    """By the contract's words: every pair of token occurrences that end together."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in printable)}

    def ends(parts):
        at = 0
        return [at := at + len(p) for p in parts]

    found, counts = [], Counter()
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != b" " + t.encode() or b"".join(bytes_b) != b" " + t.encode():
            found.append(([], [], [], []))
            continue
        at_a, at_b = ends(bytes_a), ends(bytes_b)
        both = sorted(set(at_a) & set(at_b))
        groups = [([i for i, e in zip(ids_a, at_a, strict=True) if low < e <= high], [i for i, e in zip(ids_b, at_b, strict=True) if low < e <= high]) for low, high in zip([0, *both], both, strict=False)]
        where = {e: i for i, e in zip(ids_b, at_b, strict=True)}
        pairs = [(i, where[e]) for i, e in zip(ids_a, at_a, strict=True) if e in where]
        counts.update(pairs)
        found.append((ids_a, ids_b, groups, pairs))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    show = lambda groups: hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else ""
    return [(len(x), len(y), len(g), len(p), sum(counts[q] == most[q[1]] for q in p), sum(counts[q] for q in p), show(g)) for x, y, g, p in found]


@pytest.mark.parametrize("size", [16 << 20, 500])
def test_alignment_equals_a_plain_count(spark, size):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(5, "a", None, None), (None, TEXTS[20], None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grp string, chunk int").repartition(3)
    got = alignment.align(docs, A, B, size=size).collect()
    want = plain([t for _, t, *_ in rows])
    assert sorted(tuple(map(str, r)) for r in got) == sorted((str(k), *map(str, w)) for (k, *_), w in zip(rows, want, strict=True))


def test_no_rows_and_document_counts(spark):
    docs = spark.createDataFrame([(1, "one one one"), (2, "one")], "doc_id long, text string")
    assert alignment.align(docs.limit(0), A, B).count() == 0
    links, by_documents = ({r.doc_id: r.count_sum for r in alignment.align(docs, A, B, by=by).collect()} for by in ("links", "documents"))
    assert links == {1: 12, 2: 4} and by_documents == {1: 6, 2: 2}


def test_a_small_memo_changes_nothing():
    whole, small = alignment.Aligner(A, B), alignment.Aligner(A, B)
    for t in TEXTS[15:60]:
        small.forget()
        assert small.align([t])[0][1] == whole.align([t])[0][1]
