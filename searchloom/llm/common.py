"""Shared helpers of the training-data operators: scratch tables in the cluster's shared folder and
connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and all runs in one machine's process (tests, a
    laptop) a folder of our own is made. On a cluster without that setting this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="searchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Parquet tables in the shared folder, used to cut lineage; they outlive any executor."""

    #: Folders made inside ``released()``, innermost last.
    collecting: list[list[str]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        for roots in self.collecting[-1:]:
            roots.append(self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scratch that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end: for steps whose result has been written elsewhere."""
    Scratch.collecting.append([])
    try:
        yield
    finally:
        for root in Scratch.collecting.pop():
            _delete(spark, root)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def clean_text(col: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star steps. Each round is two keyed aggregations and joins; nothing is
    gathered on the driver but one number. A hub's edges stay spread: minima combine before the shuffle and
    the join that hands them out is one that adaptive execution may split.
    """
    edges = scratch.write(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select(F.col("u").alias("k"), F.least("u", "m0").alias("m"))
        return (
            both.where("v > u").join(low, F.col("u") == F.col("k"))
            .where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        out = e.join(low, F.col("u") == F.col("k"))
        return (
            out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .distinct()
        )

    for _ in range(max_rounds):
        new = scratch.write(small_star(large_star(edges)), "stars")
        # a star forest: no head is itself a member
        done = new.join(new.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty() and (
            new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        )
        scratch.drop(edges)
        edges = new
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
