"""Shared storage: the folder of the driver and all executors, and tables stored there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that ``spark.checkpoint.dir`` names. Only where that is unset and the master is local, as in tests, a
    temporary folder is made; it goes when the process ends. On any other master an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tarnlake-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tarnlake/{name}-{uuid.uuid4().hex}"


def store_at(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes df as Parquet and returns it read back, so that its lineage ends there.

    A lost executor then costs a new read of the files, not a new run of what made them.
    """
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """store_at a new path of the shared folder."""
    return store_at(df, new_folder(df.sparkSession, name), **options)
