"""Column expressions on the edge rows that catalogues hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import dates, money, status
from tarnlake.functions import text as T
from tarnlake.functions import url as U
from tarnlake.operators import dedupe, graph, match, merge, populations, rules


def values(spark, f, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(("text", "amount"), [(None, None), ("", None), ("nan", None), ("10 lakh", 1_000_000), ("1.5 crore", 15_000_000), ("0 lakh", 0), ("10 kg", 10_000), ("Rs 10 to 20 lakh", None), ("1,00,000", 100_000), ("-5", None), ("12.9", 12), ("five", None)])
def test_parse_amount(spark, text, amount):
    assert values(spark, money.parse_amount, [text]) == [amount]


def test_funding_buckets(spark):
    assert values(spark, money.bucket, [None, 1_000_000, 1_000_001, 500_000_001], "long") == ["not_specified", "up_to_10_lakh", "10_lakh_to_1_crore", "above_50_crore"]


def test_dates_next_to_other_words(spark):
    d = dt.date
    texts = ["due 7 sept 2021.", "10 - march 2024", "march2024", "5 March2024", "x10 march 2024", "1 / 2 / 2024", "10.1.2.2024", "31 february 2024", "12 may 1999", None, "", "may 4th , 2030; 3/4/2031-4/5/2032"]
    found = values(spark, dates.extract, texts)
    assert found == [[d(2021, 9, 7)], [], [], [d(2024, 3, 5)], [], [], [d(2024, 2, 1)], [], [], [], [], [d(2030, 5, 4), d(2031, 4, 3), d(2032, 5, 4)]]


def test_union_match_meets_by_any_key(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, None)], "l int, n string, k int")
    right = spark.createDataFrame([(7, "a", 6), (8, "c", 5), (9, None, None)], "r int, n string, k int")
    got = match.union_match(left, right, [(F.col("n"), F.col("n")), (F.col("k"), F.col("k"))], "l", "r").collect()
    assert {tuple(x) for x in got} == {(1, 7), (1, 8), (2, 7)}


def test_similar_sets_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    sets = [sorted(set(rng.choices("abcdefghij", k=rng.randint(0, 9)))) for _ in range(60)]
    rows = [(i, x) for i, x in enumerate(sets)] + [(0, sets[1])]
    a, b = rows[:25] + rows[-1:], rows[25:-1] + [(99, None)]
    got = {(r.i, r.j): r.similarity for r in match.similar_sets(spark.createDataFrame(a, "i int, x array<string>"), "i", "x", spark.createDataFrame(b, "j int, y array<string>"), "j", "y", least=0.5).collect()}
    wanted = {}
    for i, x in a:
        for j, y in b:
            if x and y and (s := len(set(x) & set(y)) / len(set(x) | set(y))) >= 0.5:
                wanted[i, j] = max(s, wanted.get((i, j), 0))
    assert wanted and got == pytest.approx(wanted)


def test_population_split_tells_repeats_after_the_first_eligible(spark):
    rows = [(1, "M1", "Aid", "GRANT", "rejected", "dept", "https://a/b"), (2, "M1", "Aid", "GRANT", "", "dept", "https://a/b"), (3, "M1", "", "OTHER", "", "", ""), (4, " ", "Aid", "GRANT", "", "dept", "https://a/b"), (5, "M2", "Aid", None, None, None, "https://a/x.pdf#p"), (6, "M3", "Call", "CHALLENGE", "", "dept", "https://a/b")]
    df = spark.createDataFrame(rows, "i int, master_id string, scheme_name string, record_kind string, current_decision string, ministry string, official_page_url string")
    got = {r.i: (r.reason, r.population) for r in populations.split(df, "i").collect()}
    assert got == {1: ("REJECTED_RECORD", "EXCLUDED"), 2: ("MAIN_SCHEME_RECORD", "MAIN"), 3: ("DUPLICATE_MASTER_ID", "EXCLUDED"), 4: ("MISSING_MASTER_ID", "EXCLUDED"), 5: ("PDF_EXCEPTION_DENIED_AUTHORITY_MISSING", "EVIDENCE"), 6: ("APPLICATION_CALL_SEPARATE", "CALL")}


def test_blanks_and_white_space(spark):
    assert values(spark, T.blank_to_null, ["", " ", "None", "nan", "NULL", "x "]) == [None] * 5 + ["x"]
    assert values(spark, T.norm, [None, "a  b\n", "　"]) == ["", "a b", ""]
    assert values(spark, T.low, ["Straße"]) == ["strasse"]


def test_clean_keeps_plus(spark):
    assert values(spark, T.clean, ["a%20b+c", "50% off"]) == ["a b+c", "50% off"]


def test_keys(spark):
    assert values(spark, T.canonical_key, ["Seed Fund Homepage.PDF", None]) == ["seed fund", ""]
    assert values(spark, T.slug, ["Startup  Scheme", "programme", None]) == ["startup", "unresolved", "unresolved"]
    assert values(spark, T.identity_tokens, ["The Grants for Startups", None]) == [["grant", "startup"], []]


def test_urls(spark):
    assert values(spark, U.canonical, ["HTTP://WWW.A.org//x//y/?b=2&utm_source=z&a=1#f", "", "http://a.org"]) == ["https://www.a.org/x/y?a=1&b=2", "", "https://a.org/"]
    assert values(spark, U.kind, ["http://a/b.PDF", "http://a/b", "http://a/b.zip"]) == ["document", "html", "asset"]
    assert values(spark, U.root_domain, ["www.a.gov.in", "x.y.org", "localhost"]) == ["a.gov.in", "y.org", "localhost"]
    assert values(spark, lambda c: U.trusted(U.host(c), ["dst.gov.in"]), ["https://u@x.DST.gov.in:80/", "https://notdst.gov.in"]) == [True, False]


def test_dates(spark):
    d = dt.date
    assert values(spark, dates.iso_prefix, ["2024-01-05T10", "2024-1-5", "2024-02-30", None]) == [d(2024, 1, 5), None, None, None]
    assert values(spark, dates.call_date, ["05/02/2024", "2024-02-05", "31/02/2024"]) == [d(2024, 2, 5), d(2024, 2, 5), None]
    assert values(spark, dates.extract, ["3rd March, 2024 to April 5 2024 or 01.02.2023 and 40/40/2024"]) == [[d(2023, 2, 1), d(2024, 3, 3), d(2024, 4, 5)]]


def test_status_on_the_day(spark):
    day = F.lit("2024-01-31").cast("date")
    b = lambda c: status.bucket(F.lit("OPEN"), F.lit(None).cast("date"), c, day)
    assert values(spark, b, [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 3, 1), dt.date(2024, 3, 2), None], "date") == ["CLOSED", "CLOSING_SOON", "CLOSING_SOON", "OPEN", "OPEN"]


def test_rules(spark):
    assert values(spark, lambda c: rules.keyword_score(c, {"a": 70, "b": 50, "c": -200}), ["ab", "c", ""]) == [100, 0, 0]
    assert values(spark, populations.support_type, ["Credit guarantee", None, "thing"]) == ["CREDIT_OR_LOAN", "SUPPORT_TYPE_NOT_SPECIFIED", "OTHER_PROGRAMME_SUPPORT"]


def test_dedupe_and_merge(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "", "y"), (3, "a", "z"), (4, None, "w")], "o int, k string, v string")
    assert {r.o for r in dedupe.first_wins(df, "k", "o").collect()} == {1}
    assert {r.o for r in dedupe.first_wins(df, "k", "o", keep_blank=True).collect()} == {1, 2, 4}
    base, delta = df.where("o < 3").select("o", "v"), spark.createDataFrame([(2, "new"), (9, "nine")], "o int, v string")
    assert sorted(map(tuple, merge.upsert(base, delta, ["o"]).collect())) == [(1, "x"), (2, "new"), (9, "nine")]
    assert sorted(map(tuple, merge.insert_ignore(base, delta, ["o"]).collect())) == [(1, "x"), (2, "y"), (9, "nine")]
    assert dict(map(tuple, merge.compare(base, delta, "o", ["v"]).collect())) == {1: "REMOVED", 2: "CHANGED", 9: "ADDED"}


def test_tree_without_cycles(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "id long, parent long")
    assert dict(map(tuple, graph.tree_levels(nodes, "id", "parent", 8).collect())) == {1: 0, 2: 1, 3: 2, 4: 0}


def test_deep_trees_are_whole(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(41)] + [(50, 51), (51, 50)], "id long, parent long")
    assert sorted(map(tuple, graph.tree_levels(chain, "id", "parent").collect())) == [(i, i) for i in range(41)]
    with pytest.raises(RuntimeError):
        graph.tree_levels(chain, "id", "parent", 3)


def test_union_match(spark):
    a = spark.createDataFrame([(1, "x", "u"), (2, "y", None)], "l int, n string, u string")
    b = spark.createDataFrame([(7, "x", "v"), (8, "z", "u")], "r int, n string, u string")
    assert sorted(map(tuple, match.union_match(a, b, [(F.col("n"), F.col("n")), (F.col("u"), F.col("u"))], "l", "r").collect())) == [(1, 7), (1, 8)]


def test_key_classes_hold_any_two_rows(spark):
    rows = [(3, "a", "x", 1), (7, "a", "y", 2), (12, "b", "x", 1), (20, "c", "z", None), (21, "d", "z", None), (5, None, "w", 9), (6, None, "w", 9), (8, "e", "w", 9)]
    df = spark.createDataFrame(rows, "id long, name string, brand string, size int")
    got = match.key_classes(df, {"name": ["name"], "both": ["brand", "size"]}, "id")
    assert sorted(map(tuple, got.collect())) == [("both", 3, 3, 2), ("both", 5, 5, 3), ("both", 6, 5, 3), ("both", 8, 5, 3), ("both", 12, 3, 2), ("name", 3, 3, 2), ("name", 7, 3, 2)]
