"""Readers, writers and streams."""

import sqlite3

from pyspark.sql import functions as F

from tarnlake.sources import readers, writers
from tarnlake.streaming import incremental


def test_csv_and_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Scheme_Name,ID\n\"two\nlines\",1\n,2\n", encoding="utf-8")
    df = readers.canonical_columns(readers.read_csv(spark, str(tmp_path / "a.csv")), {"master_id": ["master_id", "id"], "name": ["scheme_name"], "sector": ["sector"]})
    assert [tuple(r) for r in df.orderBy("master_id").collect()] == [("1", "two\nlines", None), ("2", None, None)]


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("create table t (a int, b text)")
        db.execute("insert into t values (1, null)")
    assert [tuple(r) for r in readers.read_sqlite(spark, str(tmp_path / "s.db"), "t").collect()] == [("1", None)]
    assert readers.read_sqlite(spark, str(tmp_path / "s.db"), "none").columns == []


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    writers.publish(spark.range(3), root)
    writers.publish(spark.range(5), root)
    assert writers.current(spark, root).count() == 5
    writers.rollback(spark, root)
    assert writers.current(spark, root).count() == 3


def test_latest_is_the_same_from_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(10).select((F.col("id") % 4).alias("k"), (F.col("id") * 7 % 11 + i).alias("o"), F.lit(i).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.maintain_latest(stream, "k", "o", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out/2"))
    assert sorted((r.k, r.o) for r in got.collect()) == sorted((r.k, r.o) for r in incremental.latest_by_key(whole, "k", "o").collect())


def test_window_counts_of_a_stream(spark, tmp_path):
    df = spark.range(20).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("ts"), (F.col("id") % 2).alias("k"))
    df.write.parquet(str(tmp_path / "e"))
    out = incremental.window_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", ["k"])
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, incremental.window_counts(df, "ts", ["k"]).collect()))
