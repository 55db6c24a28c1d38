"""What the operators of this subpackage share: tables, shared storage, words and folds."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, store  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column, n: int):
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed; null is empty. Lone surrogates become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace").lower()


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


_CACHES: dict[str, object] = {}
_HOLDER = [""]


def claim(name: str, clear) -> None:
    """Tells that this worker process now fills the named cache: the caches of other operators are emptied.

    Workers outlive stages; without this, a job of many operators would hold all their caches at once.
    """
    _CACHES[name] = clear
    if _HOLDER[0] != name:
        for other, empty in _CACHES.items():
            if other != name:
                empty()
        _HOLDER[0] = name
