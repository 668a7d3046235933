"""Spark sessions set up for this engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on, and what large inputs need.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app_name: str = "tessera", **settings: str) -> SparkSession:
    """The active session, or a new one with these settings."""
    builder = SparkSession.builder.appName(app_name).config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()
