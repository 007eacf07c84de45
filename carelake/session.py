"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; a cluster's own configuration decides on partitions and memory."""
    builder = SparkSession.builder.appName("carelake").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
