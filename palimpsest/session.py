"""Session defaults for local runs; on a cluster the submitted settings stand."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "palimpsest", master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
