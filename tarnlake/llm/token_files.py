"""Token-id files: Parquet list columns with chosen encodings, row groups and page indexes.

``write_tokens`` lays documents out in ascending key order, one range of keys a file. A file holds, for each document,
its key, its ordinal and start within the file, its length and the ids. The ids are dictionary- or delta-encoded; row
groups and pages are of set sizes and carry column and offset indexes (the writer's own), so that a reader of a key
range, or of metadata alone, skips all other pages. ``read_metadata`` touches no id. ``read_tokens`` reads ids back.

Null text is an empty document; it still has the end id. Null keys come first. Repeated keys stay separate documents,
in order of text. An empty table gives empty files. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir

SCHEMA = "doc_id long, file int, ordinal long, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = 1, encoding: str = "dictionary", row_group_bytes: int = 64 << 20, page_bytes: int = 1 << 20, page_rows: int = 2_000, files: int | None = None) -> None:
    """Encodes every text and writes the files to ``path``, a folder that all executors reach."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")
    spark = docs.sparkSession

    def encoded(batches):
        from .tokens import Encoder

        encoder, file, n, start = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values, offsets = encoder.encode_flat(part.column(1).to_pylist(), end_id)
                sizes = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(sizes), file, np.int32)), pa.array(np.arange(n, n + len(sizes))), pa.array(start + offsets[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))],
                    names=["doc_id", "file", "ordinal", "local_start", "n_tokens", "ids"],
                )
                n, start = n + len(sizes), start + int(offsets[-1])

    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(files or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
        "parquet.dictionary.page.size": str(1 << 20), "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    ordered.mapInArrow(encoded, SCHEMA).write.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens), start over all files; reads no ids."""
    return _placed(spark, path).drop("ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens, ids). A filter on doc_id reaches the files' indexes."""
    return _placed(spark, path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """A file's first id is placed by the totals of the files before it: one row of two numbers a file, which is broadcast."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    firsts = totals.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(firsts), "file").withColumn("start", F.col("first") + F.col("local_start")).select("doc_id", "file", "ordinal", "start", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """tokens with ids replaced by ids_crc32, of the ids as little-endian unsigned 32-bit integers."""

    def summed(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "ids"] + [pa.array(crc, pa.int64())], names=[n for n in batch.schema.names if n != "ids"] + ["ids_crc32"])

    return tokens.mapInArrow(summed, ", ".join(f"{n} {t}" for n, t in tokens.dtypes if n != "ids") + ", ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tarnlake/token-ids-{uuid.uuid4().hex}"
