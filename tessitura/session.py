"""Session settings shared by tests, bench and ad-hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tessitura", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with AQE, UTC timestamps and Arrow; the cluster's own settings win where they exist."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if shuffle is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    return builder.getOrCreate()
