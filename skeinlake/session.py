"""A Spark session with the settings that the plans of this package expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "skeinlake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; ``conf`` adds or overrides (``__`` for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
