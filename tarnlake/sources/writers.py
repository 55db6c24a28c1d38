"""Writers: whole versions behind a numbered log, append-only logs, CSV exports."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer published first, or the plan is of another state than the one found; nothing was published."""


@dataclass(frozen=True)
class Plan:
    """What a publication is to change: on which version, by how many rows, and the digest of what it is to publish."""

    base: int
    rows: int
    added: int
    changed: int
    removed: int
    digest: str

    @property
    def rate(self) -> float:
        """Changed and removed rows over the rows that were there."""
        before = self.rows - self.added + self.removed
        return (self.changed + self.removed) / before if before else 0.0


def _row_hash(columns: list[str]) -> Column:
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in sorted(columns)])


def digest(df: DataFrame) -> str:
    """Tells a table by its rows, whatever their order: their number and the sums of two hashes of each."""
    text = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_hash(df.columns).cast("decimal(38,0)")).alias("h"), F.sum(F.conv(F.substring(text, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}-{r.h or 0}-{r.s or 0}-{'.'.join(sorted(df.columns))}"


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _local(spark: SparkSession, root: str) -> str | None:
    """The folder's plain path where it is a mounted one."""
    return _files(spark, root).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toUri().getPath() if _files(spark, root).getScheme() == "file" else None


def _commit(spark: SparkSession, root: str, number: int, entry: dict) -> None:
    """Entry `number` of the log, whole or not at all; of several writers of one number one succeeds, the others raise."""
    jvm, fs, text = spark._jvm, _files(spark, root), json.dumps(entry)
    own, last = f"{root}/log/.{uuid.uuid4().hex}", f"{root}/log/{number:012d}.json"
    here = _local(spark, root)
    if here is not None:  # a link to a file that is there fails if the name is taken
        os.makedirs(f"{here}/log", exist_ok=True)
        own, last = (p.replace(root, here, 1) for p in (own, last))
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, last)
        except FileExistsError:
            raise Conflict(f"version {number} was published by another writer") from None
        finally:
            os.remove(own)
        return
    out = fs.create(jvm.org.apache.hadoop.fs.Path(own), False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(jvm.org.apache.hadoop.fs.Path(last)) or not fs.rename(jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(last)):
        fs.delete(jvm.org.apache.hadoop.fs.Path(own), False)
        raise Conflict(f"version {number} was published by another writer")


def history(spark: SparkSession, root: str) -> list[dict]:
    """The log's entries in order: a line a publication."""
    fs, path = _files(spark, root), spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    if not fs.exists(path):
        return []
    names = sorted(str(s.getPath().getName()) for s in fs.listStatus(path))
    names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return []
    rows = spark.read.text([f"{root}/log/{n}" for n in names], wholetext=True).select(F.input_file_name().alias("f"), "value").collect()
    return [json.loads(r.value) for r in sorted(rows, key=lambda r: r.f.rsplit("/", 1)[-1])]


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version published last."""
    entries = history(spark, root)
    if not entries:
        raise ValueError("nothing is published")
    return spark.read.parquet(f"{root}/versions/{entries[-1]['version']}")


def plan(df: DataFrame, root: str, key: str) -> Plan:
    """What publishing df would change, by key, on the version that is current now. Keys are neither null nor repeated."""
    spark, entries = df.sparkSession, history(df.sparkSession, root)
    own = df.select(F.col(key).alias("k"), _row_hash([c for c in df.columns if c != key]).alias("new"))
    odd = own.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null")
    if not odd.isEmpty():
        raise ValueError(f"{key} is null or repeated")
    if entries:
        old = spark.read.parquet(f"{root}/versions/{entries[-1]['version']}")
        before = old.select(F.col(key).alias("k"), _row_hash([c for c in old.columns if c != key]).alias("old"))
    else:
        before = own.select("k", F.col("new").alias("old")).limit(0)
    both = own.join(before, "k", "full_outer")
    n = both.agg(F.count("new").alias("rows"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new") != F.col("old")).alias("changed"), F.count_if(F.col("new").isNull()).alias("removed")).first()
    return Plan(len(entries), n.rows, n.added, n.changed, n.removed, digest(df))


def publish(df: DataFrame, root: str, planned: Plan | None = None, most: float | None = None) -> str:
    """Writes a new version beside the others, then one entry of the log: readers see the old or the new version whole.

    With a plan, the version must be still the one that it was made on, and what was written must be what was planned; `most`
    refuses plans that change or remove more than that share of the rows. A writer that stops between data and log leaves a
    folder that no entry names. Of two writers at once one publishes, the other gets a Conflict.
    """
    spark, entries = df.sparkSession, history(df.sparkSession, root)
    if planned is not None:
        if planned.base != len(entries):
            raise Conflict(f"planned on version {planned.base}, but {len(entries)} is current")
        if most is not None and planned.rate > most:
            raise ValueError(f"{planned.rate:.3f} of the rows would change, more than {most}")
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    if planned is not None and digest(spark.read.parquet(f"{root}/versions/{version}")) != planned.digest:
        raise Conflict("the rows are not those of the plan")
    _commit(spark, root, len(entries), {"version": version, "rows": None} | (asdict(planned) if planned else {}))
    return version


def rollback(spark: SparkSession, root: str) -> str:
    """Publishes the version before the current one again, as an entry of its own."""
    entries = history(spark, root)
    if len(entries) < 2:
        raise ValueError("there is no earlier version")
    _commit(spark, root, len(entries), entries[-2] | {"rollback_of": entries[-1]["version"]})
    return entries[-2]["version"]


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Header, given columns in order, missing ones empty."""
    df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)
