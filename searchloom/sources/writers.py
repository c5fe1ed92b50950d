"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_object(df: DataFrame, key: str, value: str, path: str, parts: int = 1) -> None:
    """Key-value pairs as lines of one-pair objects, sorted by key in each part."""
    line = F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)))
    df.repartitionByRange(parts, key).sortWithinPartitions(key).select(line.alias("value")).write.mode("overwrite").text(path)


def word_list(df: DataFrame, path: str, with_ids: bool = False) -> None:
    """One word a line in order, or its number and the word."""
    line = F.concat_ws(" ", F.col("word_id").cast("string"), "word") if with_ids else F.col("word")
    df.orderBy("word_id" if with_ids else "word").select(line.alias("value")).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("escape", '"').csv(path)


def barrels(postings: DataFrame, placed: DataFrame, path: str, compression: str = "zstd") -> None:
    """Postings by barrel: one folder a barrel, rows sorted by word, so that a lookup reads a row group."""
    b = placed.select(F.col("word").alias("w"), "barrel_id", "offset")
    rows = postings.join(b, F.col("word") == F.col("w")).drop("w")
    rows.repartition("barrel_id").sortWithinPartitions("barrel_id", "offset").write.mode("overwrite").option("compression", compression).partitionBy("barrel_id").parquet(path)
