"""Cutting lineage and numbering rows without gathering them in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master gets a folder of its own where none is set."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="searchloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: later plans start from files that outlive any executor. Files go with the
    frames that use them where the session's cleaner is on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dense_ids(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ids 0..n-1 in the given order: rows are range-partitioned and numbered in their partitions; each
    partition's offset is the number of rows before it (one row a partition is all that comes together)."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = ranged.withColumn("__i", inside).join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return out.withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop("__part", "__p", "__n", "__i", "__before")
