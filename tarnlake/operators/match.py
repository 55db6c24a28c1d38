"""Matching of entities: exact keys of several kinds, token sets, blocked fuzzy names, aliases."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from ..functions import text as T
from ..storage import store

#: Last path segments that name a directory, not a programme.
DIRECTORY_TAILS = ("scheme", "schemes", "programme", "programmes", "schemes-programmes", "funding", "program", "programs")
#: Counters of tokens. Tokens that share one only stand later in their order than they might.
_SLOTS = 1 << 18


def union_match(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of pairs equal in any of the keys: one hash join a key instead of a join on OR."""
    out = None
    for a, b in keys:
        l, r = left.select(left_id, a.alias("__k")).where(F.col("__k").isNotNull()), right.select(right_id, b.alias("__k")).where(F.col("__k").isNotNull())
        own = l.join(r, "__k").select(left_id, right_id)
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def key_classes(df: DataFrame, keys: dict[str, Sequence[str]], ident: str) -> DataFrame:
    """(key, ident, class_id, members) of rows that equal another in all columns of a key; class_id is the class's least ident.

    A row a member and key, so a class costs its size and not its pairs. Null equals nothing.
    """
    out = None
    for name, columns in keys.items():
        rows = df.select(ident, *columns)
        classes = rows.groupBy(*columns).agg(F.min(ident).alias("class_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
        own = rows.join(classes, list(columns)).select(F.lit(name).alias("key"), ident, "class_id", "members")
        out = own if out is None else out.unionByName(own)
    return out


def _slot(token: Column) -> Column:
    return F.xxhash64(token).bitwiseAND(F.lit(_SLOTS - 1)).cast("int")


def _levels(sets: DataFrame, tokens: str, least: float) -> Callable[[Column], Column]:
    """From the slots of a row's tokens to a byte each: 0 if no set holds a token of the slot, else higher where more do, by eighths of a power of two.

    Null where fewer than `least` of the row's tokens, or none, are held.
    """
    counts = sets.select(F.explode(tokens).alias("w")).groupBy(_slot(F.col("w")).alias("slot")).agg(F.floor(8 * F.log2(F.count(F.lit(1)))).alias("level")).toArrow()
    table = np.zeros(_SLOTS, np.uint8)
    table[counts.column("slot").to_numpy()] = np.minimum(counts.column("level").to_numpy() + 1, 255)
    sent = sets.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(BinaryType())
    def level(slots: pa.Array) -> pa.Array:
        ends = slots.offsets.to_numpy()
        found = sent.value[slots.values.to_numpy()[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        held = np.diff(np.concatenate([[0], np.cumsum(found > 0)])[ends])
        kept = (held > 0) & (held >= np.ceil(np.diff(ends) * least - 1e-9))
        return pa.Array.from_buffers(pa.binary(), len(slots), [pa.py_buffer(np.packbits(kept, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(found)])

    return level


def similar_sets(left: DataFrame, left_id: str, left_set: str, right: DataFrame, right_id: str, right_set: str, *, least: float) -> DataFrame:
    """(left_id, right_id, similarity): the best Jaccard similarity of the token arrays of two ids, where it is `least` or more.

    Arrays hold distinct tokens; empty ones meet nothing. Equal arrays are compared once. Tokens are put in one order, by how
    often the left sets hold them (levels in a table of `_SLOTS` bytes) and then by themselves: what they lack comes first. Sets
    as near as `least` share a token within the first n - ceil(least * n) + 1 of each, and where it stands bounds their overlap.
    So the right arrays are worked out once, those whose first tokens are all unknown on the left end in the task that read
    them, and only keys and places of the others go through the join; survivors are compared on their full sets.
    """
    level = _levels(left, left_set, least)

    def marked(df: DataFrame, ident: str, tokens: str, s: str) -> DataFrame:
        """(id, key, set, n, first, marks) of sets with a first token that the left may hold; marks are these, from place `first` on."""
        read = df.select(F.col(ident).alias("id"), F.col(tokens).alias("set"), level(F.coalesce(F.transform(tokens, _slot), F.array().cast("array<int>"))).alias("levels"))
        known = F.filter(F.transform("set", lambda w, i: F.struct(F.substring("levels", i + 1, 1).alias("level"), w.alias("w"))), lambda x: x["level"] > F.lit(bytes(1)))
        # not filtered as a table: that would be pushed below and work the arrays out a second time
        rows = read.select("id", "set", F.explode(F.when(F.col("levels").isNotNull(), F.array(F.sort_array(known)))).alias("known"))
        n, h = F.size("set"), F.size("known")
        marks = F.transform(F.slice("known", 1, h - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1), lambda x: x["w"])
        out = rows.select("id", F.sha2(F.array_join("set", "\x1f"), 256).alias("key"), "set", n.alias("n"), (n - h).alias("first"), marks.alias("marks"))
        return store(out.toDF(*[f"{s}_{c}" for c in out.columns]), "sets-marked")

    def places(rows: DataFrame, s: str) -> DataFrame:
        return rows.select(s + "_key", s + "_n", s + "_first", F.posexplode(s + "_marks").alias("at", "token")).select("token", s + "_key", s + "_n", (F.col(s + "_first") + F.col("at")).alias(s + "_at"))

    l, r = marked(left, left_id, left_set, "l"), marked(right, right_id, right_set, "r")
    n, m = F.col("l_n"), F.col("r_n")
    near = (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (F.least(n - F.col("l_at"), m - F.col("r_at")) >= (n + m) * (least / (1 + least)) - 1e-9)
    pairs = store(places(l, "l").distinct().join(places(r, "r"), "token").where(near).select("l_key", "r_key").distinct(), "sets-pairs")

    def sets(rows: DataFrame, s: str) -> DataFrame:
        return rows.select(s + "_key", s + "_set").join(pairs.select(s + "_key"), s + "_key", "left_semi").dropDuplicates([s + "_key"])

    scored = pairs.join(sets(l, "l"), "l_key").join(sets(r, "r"), "r_key").select("l_key", "r_key", T.similarity(F.col("l_set"), F.col("r_set")).alias("similarity")).where(F.col("similarity") >= least)
    met = scored.join(l.select("l_id", "l_key"), "l_key").join(r.select("r_id", "r_key"), "r_key")
    return met.groupBy(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id)).agg(F.max("similarity").alias("similarity"))


def token_key(c: Column) -> Column:
    """The identity tokens as one key; null if there are none."""
    t = T.identity_tokens(c)
    return F.when(F.size(t) > 0, F.array_join(t, " "))


def semantic_groups(df: DataFrame, name: Column, population: Column) -> DataFrame:
    """Adds identity_key: rows of one population and token set are one identity."""
    return df.withColumn("identity_key", F.concat_ws("|", population, token_key(name)))


def same_url_identity(url: Column) -> Column:
    """The url if it names one programme: its last segment has no dot and is no directory."""
    bare = F.regexp_replace(F.lower(T.as_text(url)), "/+$", "")
    tail = F.regexp_extract(bare, r"([^/]*)$", 1)
    return F.when((bare != "") & (tail != "") & ~F.contains(tail, F.lit(".")) & ~tail.isin(*DIRECTORY_TAILS), bare)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_match(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str, *, least: float = 0.8) -> DataFrame:
    """(left_id, right_id, ratio): the best match of each left name among right names that share a token with it.

    Pairs meet by tokens, so rows without a common token are never compared.
    """
    l = left.select(left_id, F.lower(left_name).alias("ln"), T.identity_tokens(F.col(left_name)).alias("lt"))
    r = right.select(right_id, F.lower(right_name).alias("rn"), T.identity_tokens(F.col(right_name)).alias("rt"))
    met = l.withColumn("t", F.explode("lt")).join(r.withColumn("t", F.explode("rt")), "t").where(F.col(left_id) != F.col(right_id)).select(left_id, right_id, "ln", "rn").distinct()
    scored = met.withColumn("ratio", _ratio("ln", "rn")).where(F.col("ratio") >= least)
    return scored.groupBy(left_id).agg(F.max_by(F.struct(right_id, "ratio"), F.struct("ratio", -F.col(right_id))).alias("x")).select(left_id, f"x.{right_id}", "x.ratio")


def resolve_alias(df: DataFrame, title: Column, aliases: Sequence[tuple[str, str]], name: str = "parent_id") -> DataFrame:
    """Adds the id of the longest alias that the title holds as whole words; of equals the first given."""
    text = F.trim(F.regexp_replace(T.low(title), "[^a-z0-9]+", " "))
    order = sorted(range(len(aliases)), key=lambda i: (-len(aliases[i][0]), i))
    out = None
    for i in order:
        hit = F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {aliases[i][0].lower()} "))
        out = F.when(hit, aliases[i][1]) if out is None else out.when(hit, aliases[i][1])
    return df.withColumn(name, out.otherwise("") if out is not None else F.lit(""))
