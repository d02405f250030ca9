"""A session with the settings that the plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "docgrid", **settings: str) -> SparkSession:
    """Adaptive plans with skewed joins split, times in UTC; ``settings`` (dots as double underscores) go last."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
