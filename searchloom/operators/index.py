"""Forward and inverted indexes of HTML pages and of papers, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchloom.functions import text as T
from searchloom.functions import urls

MAX_POSITIONS = 15


# forward


def html_doc_words(pages: DataFrame) -> DataFrame:
    """doc_id, word: distinct words of each page and of its address, without commas."""
    body = F.transform(T.doc_tokens(T.html_text(F.col("html"))), lambda w: F.regexp_replace(w, ",", ""))
    words = F.array_distinct(F.concat(body, T.url_tokens(F.coalesce("url", F.lit("")))))
    return pages.select(F.concat(F.lit("H"), F.col("page_id")).alias("doc_id"), F.explode(words).alias("word")).where("word <> ''")


def paper_doc_words(papers: DataFrame) -> DataFrame:
    """doc_id, word: distinct words of ``papers(doc_id, title, body)``."""
    words = F.array_distinct(F.concat(T.paper_tokens(F.col("title")), T.paper_tokens(F.col("body"))))
    return papers.select("doc_id", F.explode(words).alias("word"))


def forward_index(doc_words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, word_id: one row for each document and lexicon word in it. Whether the lexicon is broadcast is left
    to its measured size."""
    return doc_words.join(lexicon, "word").select("doc_id", "word_id").distinct()


def forward_lists(forward: DataFrame) -> DataFrame:
    return forward.groupBy("doc_id").agg(F.sort_array(F.collect_list("word_id")).alias("word_ids"))


def word_names(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``rows(..., word_id)`` with the lexicon's word in place of its number; unknown numbers give no row."""
    return rows.join(lexicon.select("word_id", "word"), "word_id").drop("word_id")


def first_documents(forward: DataFrame, k: int = 100) -> DataFrame:
    """word_ids of the first ``k`` documents in the order of their ids: a report. Other documents' rows are dropped before lists are built."""
    first = forward.select("doc_id").distinct().orderBy("doc_id").limit(k)
    return forward_lists(forward.join(first, "doc_id", "left_semi"))


def merge_forward(*batches: DataFrame) -> DataFrame:
    """Batches of (doc_id, word_ids); a later batch's document replaces an earlier one's."""
    out = batches[0].withColumn("__batch", F.lit(0))
    for k, b in enumerate(batches[1:], 1):
        out = out.unionByName(b.withColumn("__batch", F.lit(k)))
    return out.groupBy("doc_id").agg(F.max_by("word_ids", "__batch").alias("word_ids"))


# inverted


def _zone(tokens: Column, name: str) -> Column:
    return F.transform(tokens, lambda w: F.struct(w.alias("word"), F.lit(name).alias("zone"), F.lit(None).cast("int").alias("pos")))


def _positions() -> Column:
    """The first positions of a word in a document; a list is bounded by the document's length."""
    return F.slice(F.sort_array(F.collect_list("pos")), 1, MAX_POSITIONS)


def html_postings(pages: DataFrame, lexicon: DataFrame | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """word, doc_id, positions, n_title, n_meta, n_heading, n_total, n_anchor, in_domain, in_url, doc_len.

    Words of the page, and those of its address, which may have no count; with a lexicon only its words.
    ``anchors(url, anchor_text)``: text of links to a page, looked up by the address as it is. A page is read and
    stripped once: its zones are one array of (word, zone, position), and one shuffle counts them all. Positions are
    the first 15.
    """
    docs = pages.select(F.concat(F.lit("H"), F.col("page_id")).alias("doc_id"), F.coalesce("url", F.lit("")).alias("url"), F.col("url").alias("own_url"), "html")
    if anchors is not None:
        docs = docs.join(anchors, "url", "left")
    tokens = F.transform(T.doc_tokens(T.html_text(F.col("html"))), lambda w, i: F.struct(w.alias("word"), F.lit("total").alias("zone"), i.cast("int").alias("pos")))
    zones = [
        F.col("tokens"), _zone(T.doc_tokens(T.html_title(F.col("html"))), "title"), _zone(T.doc_tokens(T.html_description(F.col("html"))), "meta"),
        _zone(F.flatten(F.transform(T.html_headings(F.col("html")), T.doc_tokens)), "heading"), _zone(F.coalesce(T.url_tokens(F.col("own_url")), F.array().cast("array<string>")), "url"),
    ]
    if anchors is not None:
        zones.append(_zone(T.doc_tokens(F.col("anchor_text")), "anchor"))
    docs = docs.withColumn("tokens", tokens)
    length = F.greatest(F.size("tokens"), F.lit(1)).alias("doc_len")
    hits = docs.select("doc_id", urls.domain(F.col("url")).alias("domain"), urls.path(F.col("url")).alias("path"), length, F.explode(F.concat(*zones)).alias("x"))
    hits = hits.select("doc_id", "domain", "path", "doc_len", "x.*")
    if lexicon is not None:
        hits = hits.join(lexicon.select("word"), "word", "left_semi")
    n = lambda zone: F.count_if(F.col("zone") == zone).cast("int")
    out = hits.groupBy("doc_id", "word").agg(
        _positions().alias("positions"), n("title").alias("n_title"), n("meta").alias("n_meta"), n("heading").alias("n_heading"), n("total").alias("n_total"), n("anchor").alias("n_anchor"),
        F.max(F.col("zone") != "anchor").alias("own"), F.first("domain").alias("domain"), F.first("path").alias("path"), F.first("doc_len").alias("doc_len"),
    )
    return out.where("own").select(
        "word", "doc_id", "positions", "n_title", "n_meta", "n_heading", "n_total", "n_anchor",
        F.col("domain").contains(F.col("word")).cast("int").alias("in_domain"), F.col("path").contains(F.col("word")).cast("int").alias("in_url"), "doc_len",
    )


#: Section of a paper -> group of its count.
SECTIONS = [("title", 1), ("abstract", 1), ("authors", 1), ("body", 2), ("bib", 3), ("ref", 3), ("back", 3)]


def _placed(tokens: Column, before: Column, group: int) -> Column:
    return F.transform(tokens, lambda w, i: F.struct(w.alias("word"), (before + i).alias("pos"), F.lit(group).alias("g")))


def paper_postings(papers: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """word, doc_id, positions, g1, g2, g3, n_total, doc_len of ``papers(doc_id, title, body[, abstract, authors, bib, ref, back])``.

    Positions run on from section to section.
    """
    named = [(s, g) for s, g in SECTIONS if s in papers.columns]
    docs = papers.select("doc_id", *[T.paper_tokens(F.col(s)).alias(s) for s, _ in named])
    docs = docs.withColumn("doc_len", sum((F.size(s) for s, _ in named), F.lit(0)))
    before, parts = F.lit(0), []
    for s, g in named:
        parts.append(_placed(F.col(s), before, g))
        before = before + F.size(s)
    hits = docs.select("doc_id", "doc_len", F.explode(F.concat(*parts)).alias("x")).select("doc_id", "doc_len", "x.*")
    if lexicon is not None:
        hits = hits.join(lexicon.select("word"), "word", "left_semi")
    n = lambda g: F.count_if(F.col("g") == g).cast("int")
    return hits.groupBy("doc_id", "word").agg(
        _positions().alias("positions"), n(1).alias("g1"), n(2).alias("g2"), n(3).alias("g3"), F.count(F.lit(1)).cast("int").alias("n_total"), F.first("doc_len").alias("doc_len")
    )


HTML_HITS = ["n_title", "n_meta", "n_heading", "n_total", "n_anchor", "in_domain", "in_url", "doc_len"]
PAPER_HITS = ["g1", "g2", "g3", "n_total", "doc_len"]


def drop_keys(postings: DataFrame, hits: list[str]) -> DataFrame:
    """Postings with their counters as a positional array."""
    return postings.select("word", "doc_id", "positions", F.array(*[F.col(h).cast("int") for h in hits]).alias("hits"))


def merge_postings(*parts: DataFrame) -> DataFrame:
    """Long-form postings of several parts or corpora together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def posting_lists(postings: DataFrame) -> DataFrame:
    """word, postings: one list a word, in the order of documents."""
    return postings.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("doc_id", "positions", "hits"))).alias("postings"))


def missing_ids(ids: DataFrame, n: int) -> DataFrame:
    """Ids below ``n`` that ``ids(word_id)`` lacks: empty for a dense index."""
    return ids.sparkSession.range(n).select(F.col("id").alias("word_id")).join(ids.select("word_id"), "word_id", "left_anti")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def first_postings(postings: DataFrame, k: int = 100) -> DataFrame:
    """Posting counts of the first ``k`` words that have any: a report."""
    return document_frequency(postings).orderBy("word").limit(k)


# barrels


def barrel_sizes(postings: DataFrame) -> DataFrame:
    """word, size: bytes of each word's posting list as JSON, from the postings themselves; no list is built."""
    hit = F.octet_length(F.to_json(F.struct("doc_id", "positions", "hits")))
    return postings.groupBy("word").agg((F.sum(hit) + F.count(F.lit(1)) + 1).cast("long").alias("size"))


def barrels(sizes: DataFrame, limit: int = 45 * 1024 * 1024, block: int = 100_000) -> DataFrame:
    """word, barrel_id, offset: words in order, a barrel closed when the next word would reach ``limit``.

    The packing is sequential, so only (word, size) goes through it, in one task, streamed in batches and never
    held: a barrel's state is three numbers.
    """
    import pyarrow as pa

    def pack(batches):
        barrel, at, used = 0, 0, 0
        for b in batches:
            out_b, out_o = [], []
            for size in b.column(1).to_pylist():
                if used + size >= limit:
                    barrel, at, used = barrel + 1, 0, 0
                out_b.append(barrel)
                out_o.append(at)
                at, used = at + 1, used + size
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out_b, pa.int64()), pa.array(out_o, pa.int64())], ["word", "barrel_id", "offset"])

    ordered = sizes.select("word", "size").repartitionByRange(1, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(pack, "word string, barrel_id long, offset long")


def even_barrels(lexicon: DataFrame, words: int = 50_000) -> DataFrame:
    """Barrels of a fixed number of words, without a sequential step."""
    return lexicon.select("word", F.floor(F.col("word_id") / words).cast("long").alias("barrel_id"), (F.col("word_id") % words).alias("offset"))


def anchor_texts(links: DataFrame) -> DataFrame:
    """url, anchor_text: all texts of links to an address, in order, joined by spaces; links without text are left out."""
    kept = links.where(F.col("to_url").isNotNull() & (F.coalesce("anchor_text", F.lit("")) != ""))
    return kept.groupBy("to_url").agg(F.array_join(F.sort_array(F.collect_list("anchor_text")), " ").alias("anchor_text")).withColumnRenamed("to_url", "url")


def last_section(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, pos, section, text)`` with the last non-empty section before each row, blank texts not counted."""
    seen = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when((F.trim("text") != "") & (F.coalesce("section", F.lit("")) != ""), F.col("section"))
    return rows.withColumn("last_section", F.coalesce(F.last(named, ignorenulls=True).over(seen), F.lit("")))
