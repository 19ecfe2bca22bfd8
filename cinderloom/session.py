"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cinderloom", *, master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings stand where they are given."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return b.getOrCreate()
