"""Readers: CSV, JSON, SQLite and text, with names resolved through aliases. All columns of CSV files are strings."""

from __future__ import annotations

import sqlite3
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def resolve(columns: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """By canonical name: the first alias that a column has, whatever its case."""
    have = {c.lower(): c for c in columns}
    return {k: have[found] for k, names in aliases.items() if (found := next((n.lower() for n in names if n.lower() in have), None))}


def canonical_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """A column for each canonical name, null where no alias is present."""
    found = resolve(df.columns, aliases)
    return df.select(*[(F.col(f"`{found[k]}`") if k in found else F.lit(None).cast("string")).alias(k) for k in aliases])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header, quoted line breaks, a byte order mark or none; without a schema every column is a string."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; gzip is opened."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a small local SQLite file, read-only, as strings; a missing table is an empty frame without columns.

    SQLite has no driver in Spark, so rows pass the driver process: for staging files of a catalogue, not for a corpus.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]
        if not names:
            return spark.createDataFrame([], StructType())
        rows = [tuple(None if v is None else str(v) for v in r) for r in db.execute(f'SELECT * FROM "{table}"')]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def read_if_exists(spark: SparkSession, name: str) -> DataFrame:
    """A catalogue table, or an empty frame."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], StructType())
