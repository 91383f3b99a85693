"""Session defaults; every query also runs in a session that someone else has built."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(
    app: str = "groundwork", cores: int | str = "*", shuffle_partitions: int | None = None, driver_memory: str | None = None
) -> SparkSession:
    """A local session. ``shuffle_partitions`` is left to Spark where it isn't given."""
    b = (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
