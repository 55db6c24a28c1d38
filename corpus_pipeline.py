"""The corpus pipeline: documents in, packed sequences out.

Each stage takes all rows that its predecessor kept, as Parquet, and calls one operator of tarnlake.llm; all but the last
return the columns of documents. Rows without a text pass the filtering stages: nothing in them can be rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import neardup, packing, postings, repeats, toxicity
from tarnlake.llm.common import fold, store, table
from tarnlake.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL cannot count tokens or learn toxicity: the stages are tested by brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, rejected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not rejected; rows without one stay.

    The rejected keys are stored first: their size is known then, and only where it is below Spark's limit are they broadcast.
    """
    return docs.join(store(rejected.select(key).distinct(), "rejected"), key, "left_anti").select(*COLUMNS)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows, and a column that tells them apart: doc_id, or where that is null or repeated, a number given once and stored."""
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"] and docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return docs, "doc_id"
    return store(docs.withColumn("own_row", F.monotonically_increasing_id()), "rows"), "own_row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.keep(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows that are the same, one row."""
    rows, key = _keyed(docs)
    return _without(rows, neardup.near_duplicates(rows, key=key).where(~F.col("kept")), key)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars follows. Rows stay, emptied ones too."""
    return repeats.remove_repeats(docs, with_text=True, also=("lang", "source", "n_chars")).select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    found = postings.contamination(rows.withColumnRenamed(key, "own_key"), table(spark, sf_dir, "benchmark"), key="own_key")
    return _without(rows, found.where("contaminated").select(F.col("doc_id").alias(key)), key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated passages", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
