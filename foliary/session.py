"""The session that the engine runs on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``FOLIARY_MASTER`` or the cluster decides where it runs."""
    builder = SparkSession.builder.appName("foliary").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master or os.environ.get("FOLIARY_MASTER"):
        builder = builder.master(master or os.environ["FOLIARY_MASTER"])
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
