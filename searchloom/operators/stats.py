"""Figures of timings and of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timing_stats(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, least, most, sample deviation (0 for one run) and upper middle value by key."""
    v = F.col(value)
    middle = F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)")  # counts of values, not a list of all
    return runs.groupBy(key).agg(
        F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("deviation"),
        middle.alias("median"), F.count(v).alias("runs"),
    )


def size_totals(sizes: DataFrame, by: str) -> DataFrame:
    """Entries, bytes, mean bytes, and each group's part of all bytes."""
    per = sizes.groupBy(by).agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), F.avg("size").alias("mean_bytes"))
    total = sizes.agg(F.sum("size").alias("total"))  # one row
    return per.join(F.broadcast(total)).select(by, "entries", "bytes", "mean_bytes", (F.col("bytes") / F.col("total")).alias("part"))
