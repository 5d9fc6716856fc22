"""Session settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; master, memory and shuffle width come from the caller or the cluster."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
