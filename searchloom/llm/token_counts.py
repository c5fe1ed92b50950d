"""Token counts through a digest cache.

Content digests (SHA-256 of the text, null as empty) are joined with the counts stored for this tokenizer
version; only distinct misses are encoded, once each, and appended to the cache. The cache is a Parquet
folder with one sub-folder per tokenizer version, so it can serve later runs and other jobs. A table goes through
it in batches, so even the first run over an empty cache meets stored counts from its second batch on.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each get their row; an empty
table gives an empty result; a null id stays null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import tokenizer as tok
from searchloom.llm.common import Scratch, clean_text

OVER_LIMIT = 2048
COUNTS = "digest binary, n_tokens long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _append_misses(rows: DataFrame, cache: str, tokenizer: str) -> None:
    """Encode the texts of ``rows(digest, t)`` whose digest the cache lacks, each once, and append their counts.

    Equal digests are combined in each scan task, so a text that is a third of all rows moves once a task.
    """
    spark = rows.sparkSession
    texts = rows.groupBy("digest").agg(F.any_value("t").alias("t"))
    if _exists(spark, cache):
        known = spark.read.schema(COUNTS).parquet(cache).select(F.col("digest").alias("k"))
        texts = texts.join(known, F.col("digest") == F.col("k"), "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tok.encoder(tokenizer)
        for b in batches:
            n = [len(enc.raw(t.as_py())) // 4 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    texts.select("digest", "t").mapInArrow(count, COUNTS).write.mode("append").parquet(cache)


def token_counts(
    df: DataFrame, tokenizer: str = "word_bpe_49k.json", cache_path: str | None = None, limit: int = OVER_LIMIT, batches: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``cache_path``: where counts are kept between runs; without it, a cache of this run in the shared folder.
    ``batches``: parts of the table, by hash of the id, that are looked up and appended one after the other: a part
    meets the counts that earlier ones stored, and a failed run keeps those of its finished parts.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "token-counts")
    root = cache_path or scratch.path("cache")
    cache = f"{root.rstrip('/')}/version={tok.version_digest(tokenizer)}"
    rows = df.select(F.col(id_col).alias("doc_id"), clean_text(F.col(text_col)).alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))
    for k in range(batches):
        _append_misses(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k).select("digest", "t"), cache, tokenizer)
    # Two jobs may have stored the same digest. Written out, so that the join below can split a hot digest's rows.
    counts = scratch.write(spark.read.schema(COUNTS).parquet(cache).groupBy(F.col("digest").alias("k")).agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return (
        rows.select("doc_id", "digest", F.octet_length("t").cast("long").alias("n_bytes"))
        .join(counts, F.col("digest") == F.col("k"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
