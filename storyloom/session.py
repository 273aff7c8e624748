"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "storyloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def configure(spark: SparkSession) -> SparkSession:
    """Times are UTC throughout; set it once per session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
