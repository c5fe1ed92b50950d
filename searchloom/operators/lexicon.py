"""Word statistics and lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.functions import text as T
from searchloom.tables import dense_ids

ALNUM = r"^[\p{L}\p{N}]+$"


def word_stats(tokens: DataFrame) -> DataFrame:
    """word, freq, n_domains of ``tokens(domain, word)``; counts combine before the shuffle."""
    per_domain = tokens.where("word <> ''").groupBy("word", "domain").agg(F.count(F.lit(1)).alias("n"))
    return per_domain.groupBy("word").agg(F.sum("n").alias("freq"), F.count("domain").alias("n_domains"))


def plain_words(stats: DataFrame, longest: int = 20) -> DataFrame:
    """Words of letters and digits that are frequent enough for their length and spread."""
    f, d = F.col("freq"), F.col("n_domains")
    keep = (f >= 50) | ((f >= 5) & (d >= 2)) | ((f >= 3) & (F.length("word") < 8))
    return stats.where((F.length("word") <= longest) & F.col("word").rlike(ALNUM) & keep)


def pool_words(stats: DataFrame, longest: int = 20) -> DataFrame:
    """Other words that pass the clean-up: no address, no bracket, short, in more than one domain."""
    w = F.col("word")
    return stats.where((F.length(w) <= longest) & ~w.rlike(ALNUM)).where(
        ~w.startswith("www") & ~w.startswith("http") & ~w.contains("(") & ~w.contains(")") & (F.length(w) <= 10) & (F.col("n_domains") > 1)
    )


def remaining_words(stats: DataFrame, longest: int = 20) -> DataFrame:
    """Words of the pool that are frequent enough, without commas."""
    f, d = F.col("freq"), F.col("n_domains")
    return pool_words(stats, longest).where((f >= 10) | ((f >= 5) & (d >= 2))).select(F.regexp_replace("word", ",", "").alias("word")).where("word <> ''").distinct()


def html_lexicon(stats: DataFrame) -> DataFrame:
    return plain_words(stats).select("word").union(remaining_words(stats)).distinct()


def distinct_words(tokens: DataFrame) -> DataFrame:
    return tokens.select("word").where("word <> ''").distinct()


def strict_lexicon(pages: DataFrame, seed: list[str] | None = None) -> DataFrame:
    """Valid letter words of all pages, and a seed list of short words that are always in."""
    words = pages.select(F.explode(T.strict_words(F.col("html"))).alias("word"))
    if seed:
        words = words.union(pages.sparkSession.createDataFrame([(w,) for w in seed], "word string"))
    return words.distinct()


def merge_lexicons(*lexicons: DataFrame) -> DataFrame:
    out = lexicons[0].select("word")
    for other in lexicons[1:]:
        out = out.union(other.select("word"))
    return out.select(F.trim("word").alias("word")).where("word <> ''").distinct()


def with_ids(words: DataFrame) -> DataFrame:
    """word, word_id: 0..n-1 in code-point order."""
    return dense_ids(words.select("word"), [F.col("word")], "word_id")
