"""Copies of one row, several texts of one id, and pairs at the threshold."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import neardup, postings, url_rules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block")]


def test_copies_of_one_page_fill_several_tasks(spark):
    copies = spark.range(100_000, numPartitions=4).select(F.lit(7).cast("long").alias("page_id"), F.lit("https://a.example.org/es/x").alias("url"))
    judged = url_rules.judge(copies, RULES).withColumn("task", F.spark_partition_id())
    by = judged.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.min("verdict").alias("low"), F.max("verdict").alias("high")).collect()
    assert sum(r.n for r in by) == 100_000 and {(r.low, r.high) for r in by} == {("block", "block")}
    assert len(by) == 4 and max(r.n for r in by) < 50_000


def test_a_host_across_ranges_and_repeated_rows(spark):
    urls = [f"http://h{k % 7}.example.org/{'es' if k % 2 else 'en'}/{k % 50}" for k in range(5000)] + ["http://org/"] * 500
    pages = spark.createDataFrame([(k % 900, u) for k, u in enumerate(urls)], "page_id long, url string").repartition(5)
    got = sorted((r.page_id, r.host, r.path, r.verdict) for r in url_rules.judge(pages, RULES).collect())
    cut = [(k % 900, *u.removeprefix("http://").split("/", 1)) for k, u in enumerate(urls)]
    assert got == sorted((k, h, "/" + p, "block" if h.endswith("example.org") and p.startswith("es/") else "allow") for k, h, p in cut)


def near(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, size=2).collect())


def test_texts_of_one_id_are_one_whatever_their_order(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (6, a + " more"), (9, b + " more"), (3, c), (9, c)]
    for order in itertools.islice(itertools.permutations(rows), 0, 720, 240):
        assert {k: x for k, x in near(spark, list(order))} == {5: 3, 6: 3, 9: 3, 3: 3}


def test_pairs_at_the_threshold_are_found(spark):
    """Recall of links of 0.80 to 0.85, each pair on its own: none is lost."""
    rng, rows, want = random.Random(4), [], {}
    for k in range(1600):
        n, words = rng.randrange(12, 200), itertools.count()
        own = [f"p{k}x{next(words)}" for _ in range(n + 1)]
        cut = rng.randrange(1, max(2, n // 10))
        other = own[: n + 1 - cut] + [f"p{k}y{i}" for i in range(cut)]
        one, two = ({tuple(w[i : i + 2]) for i in range(n)} for w in (own, other))
        if 80 <= 100 * len(one & two) / len(one | two) <= 85:
            rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
            want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    assert len(want) > 80
    assert dict(near(spark, rows)) == want


@pytest.mark.parametrize("shard_docs", [10, 1 << 17])
def test_wordless_documents_close_shards(spark, shard_docs):
    docs = spark.createDataFrame([(k, "a b c" if k % 40 == 0 else None) for k in range(200)], "doc_id long, text string").coalesce(1)
    index = postings.build_index(docs, shard_docs=shard_docs)
    assert index.select(F.max(F.size("docs"))).first()[0] <= shard_docs
    counts = {bytes(r.term): r.n for r in postings.term_counts(index).collect()}
    found = postings.phrase_matches(index, [((b"a", b"b", b"c"), [1]), ((b"b", b"a"), [2])], counts).collect()
    assert len(found) == 200 and sorted(r.doc_id for r in found if list(r["items"]) == [1]) == [0, 40, 80, 120, 160]
