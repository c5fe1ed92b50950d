"""A training corpus from ``documents``: identify languages, drop exact and near copies, mix sources, pack sequences.

Each stage takes what its predecessor kept, whole, and returns it with the columns of ``documents``; the last
one returns packed pieces. Nothing is sampled, capped or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from searchloom.llm import exact_dedup, language_id, mixing, near_dup, packing
from searchloom.llm.common import Scratch, released


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language, or of an uncertain one (posterior under a half), go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like ones stays: five-word shingles, a similarity of 0.8 or more."""
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.take_mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with released(spark):
            out = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)  # a stage's rows go once the next one's are written
        docs = out
    return docs


#: Language scores, shingle sets and tokens have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
