"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space.
Three stages, each grouping by digest *and* full content:

1. inside each scan task (map-side combine; one row per distinct text of the task),
2. per (digest, content, salt), the salt being the scan partition modulo ``salts``: a text that makes up a
   third of all rows is merged by many tasks,
3. per (digest, content): at most ``salts`` rows of a group are left to combine.

Every row's content has then been compared with all others of its digest. Where a digest has one content, its rows
are equal for certain, and the group is handed out to them by digest alone; where it has several, by content.

Defined results: null text counts as empty. Rows that share id and text are one document (all have the same
result; group_size counts the rows). A row without id never stays if its group has a row with one; a group
of rows without ids keeps them all, with keep_id null. ``drop_copies`` leaves one row of each group in any case.
An empty table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm.common import ASCII_SPACE, Scratch, clean_text, unused


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _normal(text: Column) -> Column:
    return F.regexp_replace(clean_text(text), ASCII_SPACE, " ")


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), _normal(F.col(text_col)).alias("t")).withColumn("digest", digest(F.col("t")))


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """digest, t, keep_id, group_size of every distinct text."""
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "t", "salt")
        .agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("c"))
    )
    return salted.groupBy("digest", "t").agg(F.min("m").alias("keep_id"), F.sum("c").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``digest`` deals the texts; any function will do."""
    scratch = Scratch(df.sparkSession, "exact-dedup")
    rows = _rows(df, id_col, text_col, digest)
    groups = _groups(rows, salts)
    groups = scratch.write(groups.select("digest", _sha256(F.col("t")).alias("sha"), "keep_id", "group_size"), "groups")
    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select(F.col("digest").alias("x_digest"))
    shared = scratch.write(shared, "shared-digests")
    result = lambda sha: ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256")]
    winners = groups.select(F.col("digest").alias("w_digest"), "sha", "keep_id", "group_size")
    clash = not shared.isEmpty()
    own = rows.join(shared, F.col("digest") == F.col("x_digest"), "left_anti") if clash else rows
    # A hot digest's rows are on one side only, so adaptive execution splits them.
    out = own.select("doc_id", "digest").join(winners, F.col("digest") == F.col("w_digest")).select(*result(F.col("sha")))
    if clash:
        held = rows.join(shared, F.col("digest") == F.col("x_digest"), "left_semi")
        whole = held.groupBy("digest", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(F.col("t").alias("w_t"), "keep_id", "group_size")
        out = out.union(held.join(whole, F.col("t") == F.col("w_t")).select(*result(_sha256(F.col("t")))))
    return out


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one row of each group of equal texts. Of rows that share the kept id
    and the text, one stays; they are combined in each scan task before they move.

    The groups name the rows that stay, so the result of ``exact_dedup`` is not needed: nothing is written, and id and digest
    are one key, which deals the rows once for both steps."""
    key, k_key = unused(df, "copy_key", "keep_key")
    of = lambda sha, i: F.concat(sha, F.coalesce(F.concat(F.lit(":"), i.cast("string")), F.lit("")))  # noqa: E731 - no id: no colon
    keep = _groups(_rows(df, id_col, text_col, digest), salts).select(of(_sha256(F.col("t")), F.col("keep_id")).alias(k_key))
    rows = df.withColumn(key, of(_sha256(_normal(F.col(text_col))), F.col(id_col))).dropDuplicates([key])
    return rows.join(keep, F.col(key) == F.col(k_key), "left_semi").select(*df.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
