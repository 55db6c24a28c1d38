"""Queries of JSON of any depth. The texts are made of the tables' rows, nested once, five and fifty times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import json_walk
from .registry import query

_DEPTHS = (1, 5, 50)


def _nested(key, leaf):
    """The leaf object, in objects and arrays by turns, as deep as the key tells."""
    out = None
    for i, n in enumerate(_DEPTHS):
        text = F.concat(F.lit('{"k":[' * (n // 2)), leaf, F.lit("]}" * (n // 2)))
        out = text if out is None else F.when(key % 3 == i, text).otherwise(out)
    return out


def _nested_sql(key: str, leaf: str) -> str:
    cases = " ".join(f"""WHEN {i} THEN repeat('{{"k":[', {n // 2}) || {leaf} || repeat(']}}', {n // 2})""" for i, n in enumerate(_DEPTHS))
    return f"CASE {key} % 3 {cases} END"


_LEAF = """'{"zone":' || s_nationkey || ',"Title":"' || CASE WHEN s_suppkey % 4 = 0 THEN ' null ' ELSE s_name END || '","list":[0,"' || s_name || ' ",{"NAME":["x",' || (s_suppkey % 7) || ']}],"name":null}'"""


def _suppliers(t):
    key, name = F.col("s_suppkey"), F.col("s_name")
    leaf = F.concat(F.lit('{"zone":'), F.col("s_nationkey").cast("string"), F.lit(',"Title":"'), F.when(key % 4 == 0, " null ").otherwise(name), F.lit('","list":[0,"'), name, F.lit(' ",{"NAME":["x",'), (key % 7).cast("string"), F.lit(']}],"name":null}'))
    return t("supplier").select(key, _nested(key, leaf).alias("j"))


@query(f"""WITH s AS (SELECT s_suppkey, {_nested_sql('s_suppkey', _LEAF)} AS j FROM supplier),
  n AS (SELECT s_suppkey, x.* FROM s, json_tree(s.j) x), m AS (SELECT s_suppkey, CASE WHEN n.type IN ('OBJECT', 'ARRAY') THEN n.value::VARCHAR ELSE n.value->>'$' END AS v, n.type, n.parent, n.id FROM n WHERE lower(n.key) IN ('title', 'name')),
  f AS (SELECT s_suppkey, v, row_number() OVER (PARTITION BY s_suppkey ORDER BY parent, id) AS r FROM m WHERE type IN ('OBJECT', 'ARRAY') OR (type <> 'NULL' AND lower(trim(v)) NOT IN ('', 'none', 'nan', 'nat', 'null')))
  SELECT s_suppkey, v AS found FROM f WHERE r = 1""")
def json_found(t):
    return json_walk.deep_find(_suppliers(t), "s_suppkey", "j", ["Name", "title"])


@query(f"""WITH s AS (SELECT s_suppkey, {_nested_sql('s_suppkey', _LEAF)} AS j FROM supplier),
  n AS (SELECT s_suppkey, x.id, trim(x.value->>'$') AS v FROM s, json_tree(s.j) x WHERE x.type NOT IN ('OBJECT', 'ARRAY', 'NULL'))
  SELECT s_suppkey, count(*) AS n, string_agg(v, '|' ORDER BY id) AS leaves FROM n WHERE v NOT IN ('', '0') GROUP BY 1""")
def json_leaves(t):
    own = json_walk.leaves(_suppliers(t), "s_suppkey", "j").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("path", "text"))).alias("x"))
    return own.select("s_suppkey", "n", F.array_join(F.col("x")["text"], "|").alias("leaves"))


@query(f"""WITH s AS (SELECT s_suppkey, {_nested_sql('s_suppkey', _LEAF)} AS j FROM supplier) SELECT s_suppkey, count(*) AS n, max(len(regexp_extract_all(x.fullkey, '[.\\[]')))::INTEGER AS depth, count(*) FILTER (x.type = 'ARRAY') AS arrays FROM s, json_tree(s.j) x GROUP BY 1""")
def json_shape(t):
    return json_walk.nodes(_suppliers(t), "s_suppkey", "j").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("path")).alias("depth"), F.count_if(F.col("kind") == "array").alias("arrays"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '[1]' ELSE
    '{"name":"' || c_name || '","segment":"' || CASE WHEN c_custkey % 2 = 0 THEN 'none' ELSE c_mktsegment END || '","at":{"nation":' || c_nationkey || ',"more":{"x":' || CASE WHEN c_custkey % 3 = 0 THEN '"filled","y":' || c_custkey ELSE '"own","y":' || c_custkey END || '}},"tags":[],"extra":[1,{"z":null}]}' END AS merged FROM customer""")
def json_merged(t):
    k, text = F.col("c_custkey"), lambda c: F.col(c).cast("string")
    base = F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('","segment":"'), F.when(k % 2 == 0, "None").otherwise(F.col("c_mktsegment")), F.lit('","at":{"nation":'), text("c_nationkey"), F.lit(',"more":{"x":'), F.when(k % 3 == 0, "null").otherwise('"own"'), F.lit('}},"tags":[]}'))
    more = F.concat(F.lit('{"segment":"none","at":{"nation":-1,"more":{"x":"filled","y":'), text("c_custkey"), F.lit('}},"tags":["t"],"extra":[1,{"z":null}]}'))
    return json_walk.merge(t("customer").select("c_custkey", F.when(k % 5 == 0, "[1]").otherwise(base).alias("b"), more.alias("c")), "c_custkey", "b", "c")
