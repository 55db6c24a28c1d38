"""The pipeline's stages on a small corpus, each against a plain computation on its own input, and the queries' shapes."""

import os
import re

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def staged(spark):
    import corpus_pipeline as P
    from tarnlake.llm.common import store

    out = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(store(stage(spark, out[-1], DIR), f"test-{name.replace(' ', '-')}"))
    return out


def test_columns_and_order(staged):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "repeated passages", "decontamination", "packing"]
    for df in staged[:-1]:
        assert df.columns == P.COLUMNS


def test_near_duplicates_keep_one_of_each_group(staged):
    texts = {r.doc_id: r.text for r in staged[1].collect()}
    kept = {r.doc_id for r in staged[2].collect()}
    sets = {}
    for k, t in texts.items():
        ws = t.lower().split()
        sets[k] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    ids, parent = sorted(sets), {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert kept == {k for k in ids if root(k) == k}


def test_repeats_are_cut_and_rows_stay(staged):
    before, after = ({r.doc_id: r for r in df.collect()} for df in staged[2:4])
    assert before.keys() == after.keys()
    least = {}
    for k in sorted(before):
        raw = (before[k].text or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if least.setdefault(raw[i : i + 50], k) < k:
                cut[i : i + 50] = b"\1" * 50
        rest = bytes(c for c, g in zip(raw, cut, strict=True) if not g).decode("utf-8", "ignore")
        assert after[k].text == rest and after[k].n_chars == (len(rest) if any(cut) else before[k].n_chars)


def test_contaminated_documents_go(spark, staged):
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 12))}
    kept = {r.doc_id for r in staged[4].collect()}
    for r in staged[3].collect():
        w, hit = words(r.text or ""), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        assert (r.doc_id in kept) == (not hit or 20 * len(hit) < len(w))


def test_packing_holds_every_document(staged):
    assert {r.doc_id for r in staged[5].collect()} == {r.doc_id for r in staged[4].collect()}


def test_clean_documents_pass_toxicity(spark, staged):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    gone = {r.doc_id for r in staged[0].collect()} - {r.doc_id for r in staged[1].collect()}
    assert all(labels.get(k, 1) == 1 for k in gone)


def test_stages_take_rows_that_break_things(spark):
    """Nulls, repeated rows and ids, empty texts and extra columns; and no rows at all."""
    import corpus_pipeline as P

    words = [f"w{i}" for i in range(60)]
    whole = " ".join(words)
    benchmark = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    rows = [(1, whole), (1, whole), (None, whole), (None, benchmark), (None, None), (2, ""), (3, " ".join(words[::-1])), (3, " ".join(words[1::2] * 2))]
    docs = spark.createDataFrame([(k, t, None, None, None, "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")
    tell = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    same = tell(docs)
    assert tell(P.drop_toxic(spark, docs, DIR)) == same
    near = tell(P.drop_near_duplicates(spark, docs, DIR))
    assert [t for _, t in near].count(whole) == 1 and len(near) == len(rows) - 2
    assert tell(P.drop_contaminated(spark, docs, DIR)) == sorted(x for x in same if x[1] != benchmark)
    assert len(tell(P.cut_repeats(spark, docs, DIR))) == len(rows)
    assert P.pack(spark, docs, DIR).count() == len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_queries_have_their_columns(spark):
    """The registered queries and run(), over a whole table: columns, rows and folds."""
    import zlib

    import corpus_pipeline as P
    from tarnlake.llm import queries

    ids = [r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()]
    columns = {
        "op1_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op2_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op3_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op4_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"}, "op5_token_ids": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op6_quality_rules": {"doc_id", "n_words", "base_failed", "kept"}, "op7_quality_classifier": {"doc_id", "held_out", "score"},
        "op8_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op9_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op10_url_filters": {"page_id", "host", "path", "rule", "verdict"},
        "op11_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
        "op12_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
        "op13_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    }
    assert columns.keys() == queries.QUERIES.keys()
    for name, wanted in columns.items():
        out = queries.QUERIES[name](spark, DIR)
        assert wanted <= set(out.columns)
        if "doc_id" in wanted:
            got = out.toPandas()
            assert set(got.doc_id) == set(ids) and (name == "op8_packing" or len(got) == len(ids))
            if "held_out" in wanted:
                n, left = (4, 2) if name == "op3_language_id" else (5, 0)
                assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == left) and 0 <= r.score <= 1 for r in got.itertuples())
    assert {r.doc_id for r in P.run(spark, DIR).collect()} <= set(ids)
