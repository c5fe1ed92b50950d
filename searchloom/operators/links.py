"""Hyperlinks, domain links and citations."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.functions import text as T
from searchloom.functions import urls


def page_links(pages: DataFrame, strict_parser: bool = False) -> DataFrame:
    """from_url, to_url, anchor_text: every link of every page, resolved and cleaned; repeated links stay, links of a page to itself go.

    ``strict_parser``: read the markup with an HTML parser, for pages that are too broken for patterns.
    """
    if strict_parser:
        found = pages.select("url", "html").mapInArrow(_parse_anchors, "url string, href string, anchor_text string")
    else:
        found = pages.select("url", F.explode(T.html_anchors(F.col("html"))).alias("a")).select("url", F.col("a.href").alias("href"), F.col("a.text").alias("anchor_text"))
    out = found.select(urls.cleaned(F.col("url")).alias("from_url"), urls.resolved(F.col("url"), F.col("href")).alias("to_url"), "anchor_text")
    return out.where(F.col("to_url").isNotNull() & (F.col("to_url") != F.col("from_url")))


def link_errors(pages: DataFrame) -> DataFrame:
    """url, href, error: links and pages that give no address. The side output that a failed record goes to."""
    found = pages.select("url", F.explode_outer(T.html_anchors(F.col("html"))).alias("a")).select("url", F.col("a.href").alias("href"))
    return found.where(urls.cleaned(F.col("url")).isNull() | (F.col("href").isNotNull() & urls.resolved(F.col("url"), F.col("href")).isNull())).withColumn("error", F.lit("address cannot be parsed"))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            href = dict(attrs).get("href")
            self.open = bool(href)
            if href:
                self.found.append([href, ""])

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open:
            self.found[-1][1] += data


def _parse_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parser = _Anchors()
            parser.feed(html or "")
            rows += [(url, href, text.strip()) for href, text in parser.found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["url", "href", "anchor_text"])


def without_garbage(links: DataFrame) -> DataFrame:
    return links.where(urls.is_page(F.col("to_url")))


def domain_links(links: DataFrame) -> DataFrame:
    """from_domain, to_domain of links between different domains; repeated ones stay."""
    out = links.select(urls.domain(F.col("from_url")).alias("from_domain"), urls.domain(F.col("to_url")).alias("to_domain"))
    return out.where(F.col("from_domain") != F.col("to_domain"))


def valid_domain_links(links: DataFrame) -> DataFrame:
    return links.dropna(subset=["from_domain", "to_domain"]).where(urls.is_valid_domain(F.col("from_domain")) & urls.is_valid_domain(F.col("to_domain")))


def link_counts(links: DataFrame, key: str) -> DataFrame:
    """Links by one end, most first: by ``to_url`` the links in, by ``from_url`` the links out."""
    return links.groupBy(key).agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), key)


def most_cited(citations: DataFrame, k: int = 10, ascending: bool = False) -> DataFrame:
    counts = citations.groupBy("to_paper").agg(F.count(F.lit(1)).alias("citations"))
    return counts.orderBy(F.col("citations").asc() if ascending else F.col("citations").desc(), "to_paper").limit(k)


def distinct_ends(links: DataFrame, a: str, b: str) -> DataFrame:
    """Every key on either end, once."""
    return links.select(F.col(a).alias("key")).union(links.select(F.col(b).alias("key"))).distinct()


def citations(papers: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """from_paper, to_paper of ``papers(paper_id, title, bib_titles)``: normalised titles, one row for each entry with a
    title field. A paper without a title takes that of ``meta(id, title)``. Self-citations stay."""
    if meta is not None:
        papers = with_titles(papers, meta)
    return papers.select(T.normalise_title(F.col("title")).alias("from_paper"), F.explode("bib_titles").alias("b")).where("b is not null").select("from_paper", T.normalise_title(F.col("b")).alias("to_paper"))


def with_titles(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """Missing titles filled in from metadata, as a column; sources are not rewritten."""
    m = meta.select(F.col("id").cast("string").alias("m_id"), F.col("title").alias("m_title"))
    out = papers.join(m, F.col("paper_id").cast("string") == F.col("m_id"), "left")
    return out.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "m_title", F.lit(""))).drop("m_id", "m_title")


def known_papers(meta: DataFrame, papers: DataFrame) -> DataFrame:
    """Metadata rows whose paper is there."""
    return meta.join(papers.select(F.col("paper_id").cast("string").alias("p")), F.col("id").cast("string") == F.col("p"), "left_semi")
