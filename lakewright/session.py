"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lakewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI rules and adaptive execution. Partition
    counts are left to adaptive execution unless the caller sets them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
