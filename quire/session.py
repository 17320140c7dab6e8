"""Session defaults. Operators work with any session; these are only for tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "quire", cores: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE on and UTC time; on a cluster spark-submit sets the master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores or '*'}]").config("spark.driver.memory", "12g")
    return builder.getOrCreate()
