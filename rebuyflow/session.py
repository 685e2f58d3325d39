"""Session settings every job relies on."""
from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "rebuyflow", **extra: str) -> SparkSession:
    """Single-JVM session for tests and the bench; a cluster job brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]")
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return (
        builder
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the results depend on; safe to repeat on a shared session.

    Instants are UTC, so the session zone must be UTC. Skew handling belongs to AQE where both join sides
    are plain shuffles; the remaining joins salt explicitly (see plans/skew.py).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark
