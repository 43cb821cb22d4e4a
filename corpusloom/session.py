"""A session with the settings the engine is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The active session, or a new one; ``settings`` with _ for . in their names go on top."""
    b = SparkSession.builder.appName("corpusloom")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
