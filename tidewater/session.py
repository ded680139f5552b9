"""The session settings that the library expects: UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive query execution; `conf` uses `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
