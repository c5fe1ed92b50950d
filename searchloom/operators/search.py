"""Ranked search over the inverted indexes: one word, or all words with their nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchloom.functions import scoring, urls
from searchloom.functions import text as T


def all_postings(html: DataFrame | None, papers: DataFrame | None) -> DataFrame:
    """Both corpora's postings with one set of columns, told apart by the first letter of doc_id."""
    zero = F.lit(None).cast("int")
    parts = []
    if html is not None:
        parts.append(html.select("word", "doc_id", "positions", "n_title", "n_meta", "n_heading", "n_total", "in_domain", "in_url", zero.alias("g1"), zero.alias("g2"), zero.alias("g3"), "doc_len"))
    if papers is not None:
        parts.append(papers.select("word", "doc_id", "positions", zero.alias("n_title"), zero.alias("n_meta"), zero.alias("n_heading"), "n_total", zero.alias("in_domain"), zero.alias("in_url"), "g1", "g2", "g3", "doc_len"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def is_html(doc_id: Column) -> Column:
    return doc_id.startswith("H")


def number(doc_id: Column) -> Column:
    return F.substring(doc_id, 2, 30).cast("long")


def with_ranks(hits: DataFrame, docs: DataFrame, page_ranks: DataFrame | None = None, domain_ranks: DataFrame | None = None, citation_ranks: DataFrame | None = None) -> DataFrame:
    """Hits with url and rank scores of ``docs(doc_id, url, title)``; a document or rank that is missing counts as '' or 0.

    Ranks are ``(key, score)``: pages by address as it is, domains by host, papers by normalised title.
    """
    out = hits.join(docs.select(F.col("doc_id").alias("d"), F.col("url").alias("d_url"), F.col("title").alias("d_title")), F.col("doc_id") == F.col("d"), "left").drop("d")
    out = out.withColumn("url", F.coalesce("d_url", F.lit(""))).withColumn("__domain", urls.domain(F.col("url"))).withColumn("__paper", T.normalise_title(F.col("d_title")))
    for name, on, ranks in (("page_rank", "url", page_ranks), ("domain_rank", "__domain", domain_ranks), ("citation_rank", "__paper", citation_ranks)):
        if ranks is None:
            out = out.withColumn(name, F.lit(0))
        else:
            r = ranks.select(F.col("key").alias("__k"), F.col("score").alias("__s"))
            out = out.join(r, F.col(on) == F.col("__k"), "left").withColumn(name, F.coalesce("__s", F.lit(0))).drop("__k", "__s")
    return out.drop("d_url", "d_title", "__domain", "__paper")


def score() -> Column:
    """Score of a hit by its corpus."""
    c = F.col
    html = scoring.html_score(c("n_title"), c("n_meta"), c("n_heading"), c("n_total"), c("in_domain"), c("in_url"), c("doc_len"), c("positions"), c("page_rank"), c("domain_rank"))
    paper = scoring.paper_score(c("g1"), c("g2"), c("g3"), c("n_total"), c("doc_len"), c("positions"), c("citation_rank"))
    return F.when(is_html(c("doc_id")), html).otherwise(paper)


def query_words(queries: DataFrame) -> DataFrame:
    """Every word that ``queries(query)`` may ask for, by either tokenizer."""
    both = F.array_union(T.query_tokens(F.col("query"), True), T.query_tokens(F.col("query"), False))
    return queries.select(F.explode(both).alias("word")).distinct()


def lookup(queries: DataFrame, placed: DataFrame, barrels: DataFrame) -> DataFrame:
    """Postings of the words of ``queries`` from stored barrels. Words are looked up with their barrels, and both are
    joined: partitions of other barrels are pruned while the query runs, whatever the number of queries."""
    found = query_words(queries).join(placed.select("word", "barrel_id"), "word")
    return barrels.join(found, ["barrel_id", "word"], "left_semi")


def single_word(queries: DataFrame, postings: DataFrame, docs: DataFrame, **ranks: DataFrame | None) -> DataFrame:
    """qid, doc_id, url, score of ``queries(qid, query)``: documents with the query's first word, best first.

    Filters on ``word`` reach the postings' files; ties go to pages, then by document number.
    """
    first = queries.select("qid", F.element_at(T.query_tokens(F.col("query"), False), 1).alias("word"))
    hits = with_ranks(postings.join(first, "word"), docs, **ranks)
    return hits.select("qid", "doc_id", "url", score().alias("score")).orderBy("qid", F.desc("score"), F.substring("doc_id", 1, 1), number(F.col("doc_id")))


def matching(queries: DataFrame, postings: DataFrame, keep: list[str]) -> DataFrame:
    """Hits of the documents that have every known word of a query, one for each occurrence of a word in the query.
    Words that no document has are ignored."""
    terms = queries.select("qid", F.posexplode(T.query_tokens(F.col("query"), True)).alias("term", "word"))
    hits = terms.join(postings, "word").select("qid", "term", "word", *keep)
    # relational division, without a second shuffle of the hits: known words by query are few
    known = hits.select("qid", "term").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("known")).withColumnRenamed("qid", "k_qid")
    docs = hits.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("have"), F.collect_list(F.struct("term", *[c for c in keep if c != "doc_id"])).alias("hits"))
    return docs.join(known, F.col("qid") == F.col("k_qid")).where("have = known").select("qid", "doc_id", "hits")


def multi_word(queries: DataFrame, postings: DataFrame, docs: DataFrame, **ranks: DataFrame | None) -> DataFrame:
    """qid, doc_id, combined_score, avg_word_score, close_matches, cluster_range, url, positions; best first."""
    counters = ["doc_id", "positions", "n_title", "n_meta", "n_heading", "n_total", "in_domain", "in_url", "g1", "g2", "g3", "doc_len"]
    found = matching(queries, postings, counters)
    rows = with_ranks(found, docs, **ranks)
    per_hit = rows.select("qid", "doc_id", "url", "page_rank", "domain_rank", "citation_rank", F.explode("hits").alias("h")).select("qid", "doc_id", "url", "page_rank", "domain_rank", "citation_rank", "h.*")
    scored = per_hit.withColumn("score", score())
    out = scored.groupBy("qid", "doc_id").agg(F.first("url").alias("url"), F.avg("score").alias("avg_word_score"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    out = out.withColumn("close_matches", scoring.close_matches(F.col("positions"))).withColumn("cluster_range", scoring.cluster_range(F.col("positions")))
    out = out.withColumn("combined_score", F.col("close_matches") + F.col("avg_word_score"))
    return out.select("qid", "doc_id", "combined_score", "avg_word_score", "close_matches", "cluster_range", "url", "positions").orderBy(
        "qid", F.desc("combined_score"), F.substring("doc_id", 1, 1), number(F.col("doc_id"))
    )


def closest_first(results: DataFrame, k: int = 15) -> DataFrame:
    """Of each query the ``k`` documents with most close matches, and their ``place``: a report. Tasks keep their own
    best ``k`` of a query before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("close_matches"), F.substring("doc_id", 1, 1), number(F.col("doc_id")))
    return results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).orderBy("qid", "place")


def reduced_search(queries: DataFrame, html: DataFrame) -> DataFrame:
    """qid, doc_id, score by the reduced score, pages only."""
    first = queries.select("qid", F.element_at(T.query_tokens(F.col("query"), False), 1).alias("word"))
    c = F.col
    return html.join(first, "word").select("qid", "doc_id", scoring.reduced_html_score(c("n_title"), c("n_meta"), c("n_heading"), c("n_total")).alias("score"))


def top(results: DataFrame, k: int = 15, by: str = "score") -> DataFrame:
    return results.orderBy(F.desc(by), F.substring("doc_id", 1, 1), number(F.col("doc_id"))).limit(k)
