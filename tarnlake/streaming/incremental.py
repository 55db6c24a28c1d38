"""Incremental operators: the same results from a stream, batch by batch, as from all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_counts(events: DataFrame, time: str, keys: list[str], *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key; rows later than `late` are dropped by the watermark."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def first_seen(events: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def maintain_latest(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row of each key in a folder of versions; a batch that is run again gives the same version."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        known = batch
        if n > 0:
            known = spark.read.schema(batch.schema).parquet(f"{path}/{n - 1}").unionByName(batch)
        latest_by_key(known, key, order).write.mode("overwrite").parquet(f"{path}/{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
