"""Where links come from, and what records take over from their parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store


def reverse_links(links: DataFrame, target: str, order: Sequence[str | Column], most: int = 30) -> DataFrame:
    """The first `most` links of each target by `order`, with their place (rank, from 1).

    `most` is the report's own limit. Spark ranks within tasks first and ships at most `most` links a target from each, so
    a target that all pages link to keeps no task's memory. Links without a target are left out.
    """
    place = F.row_number().over(Window.partitionBy(target).orderBy(*order))
    return links.where(F.col(target).isNotNull()).withColumn("rank", place).where(F.col("rank") <= most)


def link_contexts(links: DataFrame, target: str, source: str, anchor: str, site_wide: int = 100) -> DataFrame:
    """(target, occurrences, sources, self_links, anchors, first_anchor, site_wide): what the links of each target tell.

    Links are counted by target and source first, so that a target of very many links is spread over its sources. A target
    is site-wide when at least `site_wide` sources link to it.
    """
    pairs = links.where(F.col(target).isNotNull()).groupBy(target, source, anchor).agg(F.count(F.lit(1)).alias("__n"))
    by_source = pairs.groupBy(target, source).agg(F.sum("__n").alias("__n"), F.count(F.nullif(F.col(anchor), F.lit(""))).alias("__a"), F.min(F.nullif(F.col(anchor), F.lit(""))).alias("__f"))
    texts = pairs.where(F.col(anchor) != "").select(target, anchor).distinct().groupBy(target).agg(F.count(F.lit(1)).alias("anchors"))
    own = by_source.groupBy(target).agg(F.sum("__n").alias("occurrences"), F.count(source).alias("sources"), F.min("__f").alias("first_anchor"))
    return own.join(texts, target, "left").select(target, "occurrences", "sources", F.coalesce("anchors", F.lit(0)).alias("anchors"), "first_anchor", (F.col("sources") >= site_wide).alias("site_wide"))


def inherit(records: DataFrame, ident: str, parent: str, value: str, order: str, takes: Column, confidence: str, least: float = 0.55, loss: float = 0.1) -> DataFrame:
    """records with value, confidence and inherited (hops from the record it comes from; null for own values and for none).

    What a sequential pass over the records by `order` gives: a record without a value that `takes` one gets its parent's if the
    parent has one by then, so a value passes on only through parents that stand earlier. Each hop lowers the confidence
    by `loss`, to `least` at the least. Of records of one ident the last by `order` is the parent. orders are distinct.
    Paths are halved by pointer jumping: as many stored rounds as the logarithm of the longest chain.
    """
    ok = F.coalesce(takes, F.lit(False))
    rows = store(records.withColumns({"__takes": ok, "__own": F.col(value).isNotNull()}), "inherit")
    last = rows.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("__i")).agg(F.max_by(F.struct(F.col(order).alias("o"), F.col("__own").alias("own"), F.col("__takes").alias("takes"), F.col(parent).alias("parent")), order).alias("__p"))
    # a step goes from a record to its parent's record, named by its order: done where that has its own value
    steps = rows.where(~F.col("__own") & F.col("__takes") & F.col(parent).isNotNull()).select(F.col(order).alias("o"), F.col(parent).alias("__i")).join(last, "__i")
    live = steps.where(F.col("__p.own") | (F.col("__p.takes") & F.col("__p.parent").isNotNull() & (F.col("__p.o") < F.col("o"))))
    live = store(live.select("o", F.col("__p.o").alias("to"), F.lit(1).alias("hops"), F.col("__p.own").alias("done")), "inherit-steps")
    while not live.where("not done").isEmpty():
        beyond = live.select(F.col("o").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"))
        # one that points to a record without a step of its own can inherit nothing
        moved = live.where("not done").join(beyond, "to").select("o", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("done2").alias("done"))
        live = store(live.where("done").unionByName(moved), "inherit-steps")
    given = live.select("to", F.col("o").alias("__o"), F.col("hops").alias("__hops")).join(rows.select(F.col(order).alias("to"), F.col(value).alias("__v"), F.col(confidence).alias("__c")), "to").drop("to")
    out = rows.join(given, F.col(order) == F.col("__o"), "left")
    lowered = F.round(F.greatest(F.lit(least), F.coalesce("__c", F.lit(0.0)) - F.lit(loss) * F.col("__hops")), 3)
    kept = [c for c in records.columns if c not in (value, confidence)]
    return out.select(*kept, F.coalesce(value, "__v").alias(value), F.when(F.col("__hops").isNotNull(), lowered).otherwise(F.col(confidence)).alias(confidence), F.col("__hops").alias("inherited"))
