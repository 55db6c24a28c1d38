"""The text operators on small fixtures: brute force, and the rows that break things."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tarnlake.llm import components, cotraining, langid, line_rules, neardup, packing, postings, repeats, suffix_groups, token_files, toxicity, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, bucket int, h string"
random.seed(3)
WORDS = [f"w{i}x" for i in range(300)]


def prose(n, words=WORDS):
    return " ".join(random.choice(words) for _ in range(n))


BASE = prose(120)
TEXTS = {
    0: BASE, 1: BASE, 2: BASE.replace(BASE.split()[60], "other", 1), 3: None, 4: "", 5: "one", 6: "one", 7: prose(6000), 8: prose(90), 9: BASE[:300] + " " + prose(60),
    10: "ÀÉ ß ı 漢字 " * 40, 11: "a\nb\n\nb\n" * 30, 12: prose(40) + "\n" + BASE[100:260] + "\n" + prose(40), 13: " \t\n", 14: "x" * 130, 15: "x" * 60,
}


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, a repeated row, other columns with names that operators use."""
    rows = [(k, t, "en" if k % 3 else None, "s" if k % 2 else None, None if t is None else len(t), "id", 1, 2, "h") for k, t in TEXTS.items()]
    rows += [rows[5], (None, "no id " + BASE, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def exact(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer()).encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, none, tmp_path):
    for encoding in ("dictionary", "delta"):
        token_files.write_tokens(docs, tokenizer(), path := str(tmp_path / encoding), encoding=encoding, row_group_bytes=1 << 16, page_rows=4)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.checksums(token_files.read_tokens(spark, path)).collect())
        items = sorted([(k, t or "") for k, t in TEXTS.items()] + [(5, "one"), (-1, "no id " + BASE)])
        start, want = 0, []
        for (k, _), ids in zip(items, exact([t for _, t in items]), strict=True):
            want.append((start, None if k < 0 else k, len(ids) + 1, crc([*ids, 1])))
            start += len(ids) + 1
        assert got == want
        assert [r.n_tokens for r in token_files.read_metadata(spark, path).orderBy("start").collect()] == [w[2] for w in want]
    token_files.write_tokens(none, tokenizer(), path := str(tmp_path / "none"))
    assert token_files.read_tokens(spark, path).count() == 0


def test_packing(docs, none):
    out = packing.pack_documents(docs, tokenizer(), capacity=256).collect()
    items = {k: [*ids, 0] for k, ids in zip(TEXTS, exact([t or "" for t in TEXTS.values()]), strict=True)}
    for k, ids in items.items():
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == k})
        assert own == [(i, a, len(ids[a : a + 256]), crc(ids[a : a + 256])) for i, a in enumerate(range(0, len(ids), 256))]
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= -(-sum(r.length for r in out) // 256) + 1
    assert packing.pack_documents(none, tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plans_hold_all(seed):
    rng = random.Random(seed)
    h = {}
    for _ in range(rng.choice([1, 10, 300, 2000])):
        n = rng.choice([rng.randint(1, 100), rng.randint(1, 20), 50, 51])
        h[n] = h.get(n, 0) + 1
    plan = packing.solve(h, 100, rounds=10)
    got = {}
    for times, use in plan:
        assert sum(a * b for a, b in use) <= 100
        for a, b in use:
            got[a] = got.get(a, 0) + times * b
    assert got == h
    sizes = np.array(sorted(h))
    assert sum(n for n, _ in plan) <= sum(n for n, _ in packing._best_fit(sizes, np.array([h[int(k)] for k in sizes]), 100))


def brute_sets(texts, size):
    out = {}
    for k, t in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[k] = {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()
    return out


def test_near_duplicates(docs, none):
    sets = brute_sets(TEXTS, 4)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = neardup.near_duplicates(docs, size=4).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), r.doc_id == root(r.doc_id))
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_link_through_members(spark):
    """A chain: neighbours are near, the ends are not; the least id is an end."""
    words, texts = [f"v{i}" for i in range(200)], []
    for k in range(8):
        texts.append(" ".join(words))
        for j in range(4):
            words[k * 16 + j * 3] = f"new{k}{j}"
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=4)
    assert {r.component_id for r in got.collect()} == {0}


def test_near_duplicates_at_the_threshold_with_a_low_estimate(spark):
    """8 of 10 shingles are common, but the registers say 0.69: the pair is compared on its full sets all the same."""
    a = [f"s26970w{j}" for j in range(12)]
    b = [*a[:-1], "end"]
    x, y = (neardup.registers(neardup.shingles(" ".join(t), 4))[None] for t in (a, b))
    assert neardup.estimate(x, y, np.array([9.0]), np.array([9.0]))[0] < 0.7
    got = neardup.near_duplicates(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string"), size=4)
    assert {r.component_id for r in got.collect()} == {1}


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[400:2400]
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert (neardup.merge(ra, rb) == neardup.registers(np.union1d(a, b))).all()
    assert abs(neardup.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0] - 1600 / 2400) < 0.12


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_suffix_array():
    for _ in range(300):
        s = [random.randrange(random.choice([1, 2, 5])) for _ in range(random.randint(0, 40))]
        assert suffix_groups.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats(docs, none):
    raw = {k: (t or "").encode() for k, t in TEXTS.items()}
    least = {}
    for k in sorted(raw):
        for i in range(len(raw[k]) - 49):
            least.setdefault(raw[k][i : i + 50], k)
    for r in repeats.remove_repeats(docs, with_text=True, also=("lang", "id", "row")).collect():
        own = raw[r.doc_id] if r.doc_id is not None else ("no id " + BASE).encode()
        gone = bytearray(len(own))
        for i in range(len(own) - 49):
            if r.doc_id is not None and least[own[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = b"\1" * 50
        rest = bytes(c for c, g in zip(own, gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(own), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest())
        assert (r.text or "") == rest.decode("utf-8", "ignore")
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_across_tasks_are_those_of_brute_force(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choices("abcdé ", k=rng.choice([49, 50, 51, 90, 400]))) for _ in range(12)]
    rows = [(rng.choice([i, i, i // 2]), "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("xyz ", k=30)) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(None, passages[3]), (None, passages[3]), (3, None), (7, ""), (500, "".join(rng.choices("abcdefgh", k=150_000)) + passages[4] + "q" * 150_000), (501, "q" * 60), rows[5], rows[5]]
    raw = [(t or "").encode() for _, t in rows]
    least = {}
    for (k, _), r in zip(rows, raw, strict=True):
        for i in range(len(r) - 49) if k is not None else ():
            w = r[i : i + 50]
            least[w] = min(k, least.get(w, k))
    wanted = []
    for (k, _), r in zip(rows, raw, strict=True):
        cut = bytearray(len(r))
        for i in range(len(r) - 49) if k is not None else ():
            if least[r[i : i + 50]] < k:
                cut[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, gone in zip(r, cut, strict=True) if not gone)
        wanted.append((str(k), len(r), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(kept).hexdigest()))
    for parts in (1, 9):
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(wanted)


def test_repeats_are_told_on_bytes_not_on_hashes():
    import pyarrow as pa

    texts, one = [b"a" * 60, b"b" * 60, b"a" * 60], np.zeros(3, np.int64)
    same = np.ones(3, np.uint64)  # all contexts collide
    gone, runs = repeats._local(texts, np.array([1, 2, 3]), np.arange(3), one, one + 10, same, same, 50)
    assert gone.tolist() == [False, False, True] and runs == [(2, 0, 10)]
    docs = pa.table({"doc_id": [2], "text": ["b" * 60]})
    equal = {"kind": [2], "block": [0], "doc": [2], "tag": [zlib.crc32(b"b" * 60)], "first": [0]} | {n: pa.array([None], pa.binary()) for n in ("docs", "tags", "firsts", "lasts")}
    assert repeats._strip(docs, pa.table({**equal, "context": [b"b" * 55]}).select([*equal, "context"]).filter([True]), 50, False, ()).column("n_removed").to_pylist() == [55]
    with pytest.raises(ValueError, match="share a hash"):
        repeats._strip(docs, pa.table({**equal, "context": [b"a" * 55]}), 50, False, ())


def test_contamination(spark, docs, none):
    items = [(1, " ".join(BASE.split()[10:40])), (2, "one"), (3, None), (4, prose(30)), (10, BASE.upper()), (None, BASE), (11, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for k, t in items:
        ws = re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if k is not None else []
        for i in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[i : i + 13]), set()).add(k)
    for r in postings.contamination(docs, bench).collect():
        t = TEXTS[r.doc_id] if r.doc_id is not None else "no id " + BASE
        ws = re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        hit, found = set(), set()
        for w, own in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= own
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(ws), len(hit), len(found), postings.sha256_of(list(found)), len(hit) > 0 and 20 * len(hit) >= len(ws))
    assert postings.contamination(none, bench).count() == 0
    assert not any(r.n_hit for r in postings.contamination(docs, bench.limit(0)).collect())


def test_blocks_of_phrases_agree(docs):
    phrases = postings.windows([(1, BASE), (2, TEXTS[8])])
    index = postings.build_index(docs, shard_words=500).cache()
    counts = {bytes(r.term): r.n for r in postings.term_counts(index).collect()}
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.n_hit, r.items_sha256) for r in postings.digest(df).collect())
    assert key(postings.phrase_matches(index, phrases, counts)) == key(postings.phrase_matches(index, phrases, counts, block_bytes=4_000))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x x b")], "doc_id long, text string")
    index = postings.build_index(docs).cache()
    counts = {bytes(r.term): r.n for r in postings.term_counts(index).collect()}
    assert sorted(map(tuple, postings.proximity_matches(index, [((b"a", b"b"), 5)], counts, 4).collect())) == [(1, 5, 0, 3), (2, 5, 0, 1)]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/x?y#z", "https://a.example.org/en/12", "https://a.b.org/q", "http://notorg/", "http://x.com/fr/", "http://x.com/de/1", "http://x.com/", "ftp://com/fr/1", "http://example.org", "http://example.org/es/x?y#z"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    pages = spark.createDataFrame([(i if i else None, u, "k", 1, "x") for i, u in enumerate(urls)], "page_id long, url string, key string, salt int, host string")
    for r in url_rules.judge(pages, rules).collect():
        u = urls[r.page_id or 0] or ""
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_segments_are_maximal():
    for _ in range(200):
        s = [random.choice([-3, -1, 0, 1, 2, 5]) for _ in range(random.randint(0, 14))]

        def best(lo, hi):
            """All maximal scoring segments of s[lo:hi], by definition: the best one, then left and right of it."""
            found = max(((sum(s[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            return [] if found[0] <= 0 else [*best(lo, found[3]), (found[3], found[4] - 1, found[0]), *best(found[4], hi)]

        got = toxicity.segments(s)
        assert sum(x for *_, x in got) == sum(x for *_, x in best(0, len(s)))
        assert all(sum(s[a : b + 1]) == x for a, b, x in got)
        s = [x + random.random() / 100 for x in s]  # without ties the segments are the same
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(a, b) for a, b, _ in best(0, len(s))]


def test_calibration_holds_on_random_scores():
    """lambda and K, fitted on half of simulated texts, tell how often the other half's best segments pass a score."""
    rng = np.random.default_rng(5)
    values, share = np.array([-1.0, 0.5, 2.0]), np.array([0.8, 0.15, 0.05])
    scale = toxicity.decay(values, share)
    assert share @ np.exp(scale * values) == pytest.approx(1)
    assert toxicity.decay(np.array([-1.0, 3.0]), np.array([0.5, 0.5])) == 0 and toxicity.decay(np.array([-1.0]), np.array([1.0])) == 0
    n = rng.integers(50, 400, 1500)
    best = np.array([max((x for *_, x in toxicity.segments(rng.choice(values, k, p=share).tolist())), default=0.0) for k in n])
    size = toxicity.extent(best[:750], n[:750], scale, 0.5)
    expected = size * n[750:] * np.exp(-scale * best[750:])
    for level in (0.02, 0.1, 0.3):
        assert np.mean(expected <= level) == pytest.approx(1 - math.exp(-level), abs=0.05)


def test_toxicity(spark, docs, none):
    bad = ["vile", "nasty", "awful"]
    rows = [(i, prose(60) + (" " + prose(3, bad) + " " + prose(20) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    data, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(data.where("doc_id < 450"), labels)
    got = {r.doc_id: r for r in toxicity.score(data, model).collect()}
    assert sum(got[i].predicted == y for i, _, y in rows[450:]) >= 0.97 * 150
    assert any(r.expected < 1 for r in toxicity.passages(data, model).collect())
    assert toxicity.score(docs, model).count() == len(TEXTS) + 2
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(none, labels)).collect()} == {toxicity.Model({}, 0, 0, 1, 0).probability(0)}


def test_language(spark, docs, none):
    rows = [(i, prose(30, ["the", "and", "thing"] if i % 2 else ["der", "und", "ding"]), "en" if i % 2 else "de") for i in range(200)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(data.where("doc_id < 150"), per_language=40)
    assert all(r.lang_pred == rows[r.doc_id][2] and 0.5 <= r.score <= 1 for r in langid.identify(data, model).collect())
    by_id = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [by_id[k].lang_pred for k in (3, 4, 13)] == ["und"] * 3 and len(by_id) == len(TEXTS) + 1
    assert langid.identify(none, langid.fit(none)).count() == 0


def test_code_lengths_are_those_of_the_context_trees():
    """Against the definition: the longest known context, escapes to shorter ones without the bytes seen, down to all bytes alike."""
    samples = {"a": [b"abracadabra" * 4, b"cab"], "b": [b"banana bandana" * 3]}
    order, least = 3, 3
    model = langid.grow(samples, order, least)
    sizes = {x: sum(len(t) + order for t in samples[x]) for x in samples}
    enough = {x: max(2, least * sizes[x] / max(sizes.values())) for x in samples}

    def seen(lang, context):
        counts = {}
        for t in samples[lang]:
            padded = b"\n" * order + t
            for i in range(order, len(padded)):
                if padded[i - len(context) : i] == context:
                    counts[padded[i]] = counts.get(padded[i], 0) + 1
        return counts

    def p(lang, context, byte):
        shorter = (lambda b: p(lang, context[1:], b)) if context else (lambda b: 1 / 256)
        if context and not any(sum(seen(x, context).values()) >= enough[x] for x in samples):
            return shorter(byte)
        counts = seen(lang, context)
        total, kinds = sum(counts.values()), len(counts)
        if not kinds:
            return shorter(byte)
        if byte in counts:
            return counts[byte] / (total + kinds)
        return kinds / (total + kinds) * shorter(byte) / (1 - sum(shorter(b) for b in counts))

    for context in (b"", b"a", b"an", b"ab"):
        assert sum(p("a", context, b) for b in range(256)) == pytest.approx(1)
    text = b"abba bandcab"
    padded = b"\n" * order + text
    for j, lang in enumerate(model.langs):
        want = sum(-np.log2(p(lang, padded[i - order : i], padded[i])) for i in range(order, len(padded)))
        assert model.code_lengths([text])[0, j] == pytest.approx(want, rel=1e-5)
    assert (model.code_lengths([text, b"", text], chunk=5)[2] == pytest.approx(model.code_lengths([text])[0], rel=1e-5))


def test_line_rules(docs, none):
    got = {r.doc_id: r for r in line_rules.judge(docs, most_docs=1).collect() if r.doc_id is not None}
    for k, t in TEXTS.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        spots = {}
        for i in range(len(ws) - 7):
            spots.setdefault(tuple(ws[i : i + 8]), []).append(i)
        n = len({j for own in spots.values() if len(own) > 1 for i in own for j in range(i, i + 8)})
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[k].n_words, got[k].word_chars, got[k].n_dup_lines, got[k].n_repeat_words) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), n)
        assert got[k].base_failed == (len(ws) < 20 or 100 * n > 30 * len(ws))
    assert got[0].kept and not got[4].kept
    assert line_rules.judge(none).count() == 0


def test_cotraining(spark, docs, none):
    rows = [(i, prose(60) if i % 2 else "#$% " * 60, "en", f"s{i % 2}", 300, i % 2) for i in range(400)]
    data = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] < 200], "doc_id long, quality int")
    model = cotraining.fit(data, labels)
    got = {r.doc_id: r.predicted for r in cotraining.score(data, model).collect()}
    assert sum(got[r[0]] == r[5] for r in rows) >= 0.97 * 400
    assert cotraining.score(docs, model).count() == len(TEXTS) + 2
    assert cotraining.score(none, cotraining.fit(none, labels.limit(0))).count() == 0
