"""A session with the settings that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Dates are naive and mean UTC; ticker-like partition values such as 0700 stay text; touched partitions alone are overwritten.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "tidewright", **extra: str) -> SparkSession:
    """The running session with these settings, or a new one.  Names in extra use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
