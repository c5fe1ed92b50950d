"""Licence scan by canonical digest lookup.

Every text is brought to a canonical form - lower case, copyright lines dropped, spellings that licence
matching treats as equal replaced by one of them, punctuation and white space reduced to single spaces -
and the SHA-256 of the entire canonical text is joined to the digests of known licence texts. Built-in
functions only; the digest table is fixed and tiny, so it is broadcast whatever the corpus.

Defined results: a null or empty text, or one whose canonical form is empty, matches nothing and has the
digest of the empty text; repeated rows each get their row; an empty table gives an empty result; a null id
stays null. Columns other than id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm.common import clean_text
from searchloom.llm.license_texts import KNOWN, SPELLINGS

# A line is a copyright line if it begins with a copyright sign or word and names a year or a holder, or
# reserves all rights. Words that follow "copyright" in a licence's own text are no holder.
BODY_WORDS = "|".join(sorted({"owner", "owners"} | {w for _, t in KNOWN for w in re.findall(r"copyright\s+([a-z]+)", t.lower())}))
COPYRIGHT_LINE = rf"(?:^|\n)[ \t]*(?:(?:portions )?copyright(?![a-z])[ \t:,]*+(?!(?:{BODY_WORDS})\b)[^\s.]|\(c\)|\x{{00A9}}|all rights reserved)[^\n]*"
# the SQL's engine has no look-ahead: it drops every line that begins with the word
SQL_COPYRIGHT_LINE = r"(?:^|\n)[ \t]*(?:(?:portions )?copyright|\(c\)|\x{00A9}|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(clean_text(text)), COPYRIGHT_LINE, "\n")
    # two spaces between words: each word has spaces of its own, so neighbours are replaced as well
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORD, "  ")), F.lit(" "))
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(_apart(spelling)), F.lit(_apart(usual)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """license_id, digest of each known text, brought to canonical form by the same functions. ``known(license_id, text)``:
    a caller's own texts instead of the built-in ones."""
    if known is None:
        texts = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in KNOWN])
        known = spark.range(1).select(F.inline(texts))
    return known.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, canonical_sha256, license_id (null if the text is no known licence), is_license.

    ``known(license_id, text)``: a table of licence texts of any size in place of the built-in ones; it is broadcast
    only if its size allows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    digests = known_digests(df.sparkSession, known).select(F.col("digest").alias("k"), "license_id")
    return rows.join(F.broadcast(digests) if known is None else digests, F.col("canonical_sha256") == F.col("k"), "left").select("doc_id", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), '{SQL_COPYRIGHT_LINE}', chr(10), 'g')"
        out = f"' ' || trim(regexp_replace({out}, '{NOT_WORD}', '  ', 'g')) || ' '"
        for spelling, usual in SPELLINGS:
            out = f"replace({out}, {quote(_apart(spelling))}, {quote(_apart(usual))})"
        return f"sha256(trim(replace({out}, '  ', ' ')))"

    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT min(license_id) AS license_id, digest FROM
  (SELECT license_id, {canon("text")} AS digest FROM (VALUES {values}) AS v(license_id, text)) GROUP BY digest),
d AS (SELECT doc_id, {canon("text")} AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN known ON canonical_sha256 = digest
"""


ORACLE_SQL = _oracle()
