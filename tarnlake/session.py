"""Session settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tarnlake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    return builder.config(map=own | conf).getOrCreate()
