"""A session with the settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew joins, Arrow; further settings by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
