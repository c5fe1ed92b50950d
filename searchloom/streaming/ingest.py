"""Incremental indexing: pages that arrive as files become postings without a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from searchloom.operators import index


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("page_id long, url string, html string").parquet(folder)


def ingest(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's postings under its batch number. A batch that is run again after a failure overwrites its
    own folder, so every page is indexed once."""

    def write(batch: DataFrame, number: int) -> None:
        index.html_postings(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """All postings; of a page that came again, those of its last batch."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(F.col("doc_id").alias("d")).agg(F.max("batch").alias("b"))
    return rows.join(last, (F.col("doc_id") == F.col("d")) & (F.col("batch") == F.col("b"))).drop("d", "b", "batch")
