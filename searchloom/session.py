"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "searchloom", master: str | None = None, shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster, master and partitions come from its own settings."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=conf | (extra or {})).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
