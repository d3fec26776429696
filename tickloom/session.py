"""A session with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tickloom", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting, ANSI left on. Settings given win over these."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in {**conf, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
