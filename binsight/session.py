"""Session construction and cluster-safe settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every session should carry.  AQE re-plans joins/partition counts at
# runtime and splits skewed shuffle partitions; the session time zone is pinned
# so that TIMESTAMP_NTZ <-> string conversions are reproducible.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "binsight") -> SparkSession:
    """Return the active session or build a local one for tests/benchmarks.

    On a cluster the session already exists (spark-submit) and is returned
    unchanged apart from settings that are still unset.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("BINSIGHT_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
