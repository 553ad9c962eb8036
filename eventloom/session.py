"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "eventloom", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skewed joins split; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
