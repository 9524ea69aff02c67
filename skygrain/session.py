"""Session settings that the engine's results depend on, and those that only help speed."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",  # else hour 00 becomes the integer 0
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("skygrain")
    builder = builder.master(master) if master else builder
    return builder.config(map=SETTINGS | more).getOrCreate()
