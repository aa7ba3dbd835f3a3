"""A session with the settings the operators are tested under; on a cluster its own configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quern", **settings: str) -> SparkSession:
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=defaults | settings).getOrCreate()
