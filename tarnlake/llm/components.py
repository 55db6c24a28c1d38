"""Connected components of links between integer ids, by least labels and pointer jumping.

Each round gives every id the least label among its own and its neighbours', then the label of that label. Labels are
written to shared storage between rounds; neither links nor labels come to the driver, which sees one count a round. The
rounds grow with the logarithm of a component's extent. Least labels are pre-aggregated before they are dealt out, so an id
with very many links is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component) for every id of links (a, b); component is the least id reachable. Links to null are ignored."""
    both = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near")))).alias("x")).select("x.id", "x.near")
    both = store(both, "links")
    labels = store(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("component")), "labels")
    for _ in range(most_rounds):
        offered = both.join(labels.withColumnRenamed("id", "near"), "near").select("id", "component")
        least = labels.unionByName(offered).groupBy("id").agg(F.min("component").alias("component"))
        jumped = least.join(labels.select(F.col("id").alias("component"), F.col("component").alias("next")), "component").select("id", F.least("component", "next").alias("component"))
        new = store(jumped.join(labels.withColumnRenamed("component", "was"), "id").select("id", "component", (F.col("component") != F.col("was")).alias("moved")), "labels")
        labels = new.select("id", "component")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
