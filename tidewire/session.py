"""Session builder with the settings every job of this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """UTC clock, adaptive execution with skew-join splitting also below aggregates.

    Shuffle partitions are left to adaptive coalescing: start high, let Spark merge
    small ones. Pass ``spark.sql.shuffle.partitions`` explicitly for tiny local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
