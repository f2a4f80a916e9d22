"""Sessions with the settings that results and plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, sizes and folders come from the cluster's settings."""
    builder = SparkSession.builder.appName("basalt").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
