"""Session settings that the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a join partition that a hot key makes too large.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rewrites only the day partitions that a write touches.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a builder. Master, memory and partition counts stay with the cluster."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
