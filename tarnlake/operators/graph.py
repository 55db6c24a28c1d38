"""Pages and links: extraction, counts, frontiers, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_folder, store_at


def links(pages: DataFrame, ident: str = "page_id", html: str = "html") -> DataFrame:
    """(ident, ordinal, href, anchor): every link of a page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select(ident, F.posexplode(found).alias("ordinal", "x"))
    href = F.regexp_extract("x", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    anchor = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("x", r"(?is)^<a\s[^>]*>(.*)</a>$", 1), "<[^>]*>", " "), r"\s+", " "))
    return rows.select(ident, "ordinal", href.alias("href"), anchor.alias("anchor"))


def inbound(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(target, inbound_links, inbound_sources), without links of a page to itself."""
    return edges.where(F.col(source) != F.col(target)).groupBy(target).agg(F.count(F.lit(1)).alias("inbound_links"), F.count_distinct(source).alias("inbound_sources"))


def frontier(found: DataFrame, key: str, priority: str, ordinal: str, wave: int) -> DataFrame:
    """(key, priority, ordinal): the next `wave` keys, each with the highest priority it was found with."""
    best = found.groupBy(key).agg(F.max(priority).alias(priority), F.min(ordinal).alias(ordinal))
    return best.orderBy(F.desc(priority), ordinal, key).limit(wave)


def tree_levels(nodes: DataFrame, ident: str, parent: str, most: int | None = None) -> DataFrame:
    """(ident, level) from the roots down; nodes whose parent is missing are roots. Nodes on a cycle have no level.

    Each level is stored, until one is empty. Nodes below level `most`, or a path of more levels than there are nodes, raise.
    """
    known = nodes.select(F.col(ident).alias("__p"))
    roots = nodes.join(known, F.col(parent) == F.col("__p"), "left_anti").select(ident, F.lit(0).alias("level"))
    rest = nodes.select(F.col(ident).alias("__c"), F.col(parent).alias("__parent")).where(F.col("__parent").isNotNull())
    # levels are files of one folder: the result is one scan, however deep the tree
    folder = new_folder(nodes.sparkSession, "tree-levels")
    limit, level, step = most if most is not None else nodes.count(), 0, store_at(roots, f"{folder}/0")
    while not step.isEmpty():
        if level > limit:
            raise RuntimeError(f"nodes stand below level {limit}")
        level += 1
        below = rest.join(step, rest["__parent"] == step[ident]).select(F.col("__c").alias(ident), F.lit(level).alias("level"))
        step = store_at(below, f"{folder}/{level}")
    return nodes.sparkSession.read.schema(step.schema).option("recursiveFileLookup", "true").parquet(folder)


def call_sequence(df: DataFrame, group: str, date: str, ident: str) -> DataFrame:
    """Adds sequence, the number of a call in its group by date, and is_latest."""
    w = Window.partitionBy(group).orderBy(date, ident)
    back = Window.partitionBy(group).orderBy(F.desc(date), F.desc(ident))
    return df.withColumn("sequence", F.row_number().over(w)).withColumn("is_latest", F.row_number().over(back) == 1)
