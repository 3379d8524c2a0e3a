"""Session settings for large inputs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "tallyforge", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()
