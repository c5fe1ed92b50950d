"""Structured papers: flat sections and the compact form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.functions import text as T

ABSTRACT_MARK = "%Abstract%"


def _joined(texts: Column) -> Column:
    return F.array_join(F.coalesce(texts, F.array().cast("array<string>")), " ")


def flat(papers: DataFrame) -> DataFrame:
    """paper_id, doc_id, title, abstract, authors, body, bib, ref, back (texts) and bib_titles of parsed papers."""
    author = F.transform("metadata.authors", lambda a: F.array_join(F.array_compact(F.array(a["first"], a["last"], a["suffix"], a["email"])), " "))
    refs = F.coalesce(F.map_values("ref_entries"), F.array())
    bibs = F.coalesce(F.map_values("bib_entries"), F.array())
    return papers.select(
        "paper_id", F.concat(F.lit("P"), "paper_id").alias("doc_id"), F.coalesce("metadata.title", F.lit("")).alias("title"),
        _joined(F.col("abstract.text")).alias("abstract"), _joined(author).alias("authors"), _joined(F.col("body_text.text")).alias("body"),
        _joined(F.transform(bibs, lambda b: b["title"])).alias("bib"), _joined(F.transform(refs, lambda r: r["text"])).alias("ref"), _joined(F.col("back_matter.text")).alias("back"),
        F.transform(bibs, lambda b: b["title"]).alias("bib_titles"),
    )


def marked_sections(paragraphs: Column) -> Column:
    """Texts of array<struct<text, section>>; before a text whose section is named and new, a mark with its name.
    Blank texts are skipped and leave the current section as it is."""
    step = F.aggregate(
        F.coalesce(paragraphs, F.array().cast("array<struct<text:string,section:string>>")),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last")),
        lambda acc, p: F.when(F.trim(F.coalesce(p["text"], F.lit(""))) == "", acc).otherwise(
            F.struct(
                F.concat(
                    acc["out"],
                    F.when((F.coalesce(p["section"], F.lit("")) != "") & (p["section"] != acc["last"]), F.array(F.concat(F.lit("%"), p["section"], F.lit("%")), p["text"])).otherwise(F.array(p["text"])),
                ).alias("out"),
                F.when(F.coalesce(p["section"], F.lit("")) != "", p["section"]).otherwise(acc["last"]).alias("last"),
            )
        ),
    )
    return step["out"]


def compact(papers: DataFrame) -> DataFrame:
    """paper_id, title, body_text (array, with marks), bib_entries (map to title and other_ids)."""
    pick = lambda a: F.transform(a, lambda p: F.struct(p["text"].alias("text"), p["section"].alias("section")))
    abstract = F.filter(F.transform("abstract", lambda p: p["text"]), lambda t: F.trim(t) != "")
    head = F.when(F.size(abstract) > 0, F.concat(F.array(F.lit(ABSTRACT_MARK)), abstract)).otherwise(F.array().cast("array<string>"))
    return papers.select(
        "paper_id", T.clean_title(F.col("metadata.title")).alias("title"), F.concat(head, marked_sections(pick(F.col("body_text")))).alias("body_text"),
        F.transform_values("bib_entries", lambda _, b: F.struct(b["title"].alias("title"), b["other_ids"].alias("other_ids"))).alias("bib_entries"),
    )
