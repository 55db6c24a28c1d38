"""Every registered query of the engine against its SQL, and those without SQL against a plain computation."""

import os
import re
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest

from tarnlake.functions.text import IGNORED_TOKENS
from tarnlake.plans import catalogue, catalogue_load, evidence, governance, json_trees, lineage, pages, phrases, records, registry, text_parts, validation

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def rows(frame):
    """Sorted rows of a pandas frame, columns by name, numbers rounded."""
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            try:
                return f"{float(v):.7g}"
            except (TypeError, ValueError):
                return str(v)
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    own, other = registry.QUERIES[name](spark, DIR).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)


def test_fuzzy_match_keeps_the_best(spark):
    got = registry.QUERIES["fuzzy_match"](spark, DIR).toPandas()
    names = {}
    for r in spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey", "p_name").collect():
        names[r.p_name] = min(r.p_partkey, names.get(r.p_name, r.p_partkey))
    by_id = {v: k for k, v in names.items()}
    for r in got.itertuples():
        others = [SequenceMatcher(None, by_id[r.left_id].lower(), n.lower()).ratio() for n, i in names.items() if i != r.left_id and set(n.lower().split()) & set(by_id[r.left_id].lower().split())]
        assert r.ratio == pytest.approx(max(others)) and r.ratio >= 0.6
    tokens = {n: {w[:-1] if w.endswith("s") and len(w) > 4 else w for w in re.split("[^a-z0-9]+", n.lower())} - {"", *IGNORED_TOKENS} for n in names}
    found = {a for a in names for b in names if a != b and tokens[a] & tokens[b] and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.6}
    assert {by_id[r.left_id] for r in got.itertuples()} == found


def test_manifest_is_stable(spark):
    a, b = (registry.QUERIES["manifest_signature"](spark, DIR).collect() for _ in range(2))
    assert a == b and len(a[0].signature) == 64


def test_catalogue_is_registered():
    assert catalogue and catalogue_load and json_trees and phrases and evidence and governance and records and validation and len(registry.QUERIES) > 50


def test_document_tokens_are_of_all_lines(spark):
    got = {r.doc_id: set(r.tokens.split()) for r in registry.QUERIES["document_tokens"](spark, DIR).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert got.keys() == texts.keys() and any("\n" in t for t in texts.values())
    for k, t in texts.items():
        words = set(re.split("[^a-z0-9]+", t.lower())) - {"", *IGNORED_TOKENS}
        assert got[k] == {w[:-1] if w.endswith("s") and len(w) > 4 else w for w in words}
