"""Queries over the test tables, one for each operator, and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import scoring, urls
from searchloom.functions import text as T
from searchloom.operators import graph, index, lexicon, links, papers, search, stats
from searchloom.plans import oracle as O
from searchloom.sources import readers, writers
from searchloom.tables import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# inputs: pages are the HTML corpus; documents are papers, with the first line as title


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def paper_docs(spark: SparkSession, d: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select(F.concat(F.lit("P"), "doc_id").alias("doc_id"), title.alias("title"), F.substr("text", F.length(title) + 2).alias("body"))


def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select(urls.domain(F.col("url")).alias("domain"), F.explode(T.doc_tokens(T.html_text(F.col("html")))).alias("word"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def numbers(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# text


@query("tokens_doc", f"WITH {O.PAGES} SELECT page_id, len(toks) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM docs_h")
def tokens_doc(spark, d):
    return pages(spark, d).select("page_id", T.doc_tokens(T.html_text(F.col("html"))).alias("t")).select("page_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("tokens_paper", f"WITH {O.PAPERS} SELECT doc_id, len(t_title) AS n_title, len(t_body) AS n_body, md5(array_to_string(t_body, ' ')) AS body_md5 FROM docs_p")
def tokens_paper(spark, d):
    rows = paper_docs(spark, d).select("doc_id", T.paper_tokens(F.col("title")).alias("a"), T.paper_tokens(F.col("body")).alias("b"))
    return rows.select("doc_id", F.size("a").cast("long").alias("n_title"), F.size("b").cast("long").alias("n_body"), F.md5(F.array_join("b", " ")).alias("body_md5"))


SAMPLE_QUERIES = ["9/11", "COVID-19", "1,000 (cases)", "f(x)=3.14", "state-of-the-art", "C++ & C#", "", "machine  learning", "Ünïted nations' 2.0"]
_values = ", ".join(f"({k}, {O.q(x)})" for k, x in enumerate(SAMPLE_QUERIES))


@query("tokens_query", f"SELECT qid, array_to_string({O.query_tokens('q', True)}, '|') AS together, array_to_string({O.query_tokens('q', False)}, '|') AS apart FROM (VALUES {_values}) AS v(qid, q)")
def tokens_query(spark, d):
    rows = spark.createDataFrame(list(enumerate(SAMPLE_QUERIES)), "qid int, q string")
    return rows.select("qid", F.array_join(T.query_tokens(F.col("q"), True), "|").alias("together"), F.array_join(T.query_tokens(F.col("q"), False), "|").alias("apart"))


@query("strict_words", f"SELECT page_id, array_to_string({O.strict_words('html')}, ' ') AS words FROM pages")
def strict_words(spark, d):
    return pages(spark, d).select("page_id", F.array_join(T.strict_words(F.col("html")), " ").alias("words"))


@query(
    "html_fields",
    f"SELECT page_id, md5({O.html_text('html')}) AS text_md5, {O.html_title('html')} AS title, {O.description('html')} AS description, array_to_string({O.headings('html')}, '|') AS headings FROM pages",
)
def html_fields(spark, d):
    h = F.col("html")
    return pages(spark, d).select("page_id", F.md5(T.html_text(h)).alias("text_md5"), T.html_title(h).alias("title"), T.html_description(h).alias("description"), F.array_join(T.html_headings(h), "|").alias("headings"))


@query("url_parts", f"SELECT page_id, {O.domain('url')} AS domain, {O.path('url')} AS path, array_to_string(list_sort({O.url_tokens('url')}), ' ') AS tokens FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", urls.domain(u).alias("domain"), urls.path(u).alias("path"), F.array_join(F.array_sort(T.url_tokens(u)), " ").alias("tokens"))


@query("titles", f"WITH {O.PAPERS} SELECT doc_id, {O.normalise_title('title')} AS normal, {O.clean_title('title')} AS clean FROM docs_p0")
def titles(spark, d):
    return paper_docs(spark, d).select("doc_id", T.normalise_title(F.col("title")).alias("normal"), T.clean_title(F.col("title")).alias("clean"))


# lexicons


@query("word_stats", f"WITH {O.PAGES}, {O.LEXICON} SELECT * FROM stats")
def word_stats(spark, d):
    return lexicon.word_stats(page_tokens(spark, d))


@query("plain_words", f"WITH {O.PAGES}, {O.LEXICON} SELECT word FROM plain")
def plain_words(spark, d):
    return lexicon.plain_words(word_stats(spark, d)).select("word")


@query("pool_words", f"WITH {O.PAGES}, {O.LEXICON} SELECT word, freq, n_domains FROM pool")
def pool_words(spark, d):
    return lexicon.pool_words(word_stats(spark, d))


@query("remaining_words", f"WITH {O.PAGES}, {O.LEXICON} SELECT word FROM rest WHERE word <> ''")
def remaining_words(spark, d):
    return lexicon.remaining_words(word_stats(spark, d))


#: Counts of words of every kind that the clean-up tells apart: word, occurrences, domains.
WORD_COUNTS = [("co-op", 10, 2), ("co-op,", 5, 2), ("a-b", 4, 3), ("x_y", 10, 1), ("c++", 5, 2), ("www.q", 50, 5), ("http-x", 50, 5), ("(a-b)", 50, 5), ("long-and-longer", 50, 5), ("plain", 50, 5), (",", 50, 5), ("d,e", 12, 3)]
_counts = f"pool AS (SELECT * FROM (VALUES {', '.join(f'({O.q(w)}, {f}, {n})' for w, f, n in WORD_COUNTS)}) AS v(word, freq, n_domains) WHERE length(word) <= 10 AND NOT regexp_matches(word, '^[\\p{{L}}\\p{{N}}]+$') AND NOT regexp_matches(word, '^(www|http)|[()]') AND n_domains > 1)"


@query("remaining_words_of_counts", f"WITH {_counts} SELECT DISTINCT replace(word, ',', '') AS word FROM pool WHERE word <> ',' AND (freq >= 10 OR freq >= 5 AND n_domains >= 2)")
def remaining_words_of_counts(spark, d):
    return lexicon.remaining_words(spark.createDataFrame(WORD_COUNTS, "word string, freq long, n_domains long"))


@query("html_lexicon", f"WITH {O.PAGES}, {O.LEXICON} SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM html_lexicon")
def html_lexicon(spark, d):
    return lexicon.with_ids(lexicon.html_lexicon(word_stats(spark, d)))


@query("distinct_words", f"WITH {O.PAPERS}, {O.PAPER_WORDS} SELECT DISTINCT word FROM paper_words")
def distinct_words(spark, d):
    return lexicon.distinct_words(index.paper_doc_words(paper_docs(spark, d)))


SEED = ["a", "an", "the", "of", "to", "in", "is", "it", "on", "at"]


@query("strict_lexicon", f"SELECT DISTINCT unnest({O.strict_words('html')} || {SEED}) AS word FROM pages")
def strict_lexicon(spark, d):
    return lexicon.strict_lexicon(pages(spark, d), SEED)


def merged_words(spark, d):
    return lexicon.merge_lexicons(lexicon.html_lexicon(word_stats(spark, d)), index.paper_doc_words(paper_docs(spark, d)))


@query("merged_lexicon", f"WITH {O.PAGES}, {O.PAPERS}, {O.LEXICON}, {O.PAPER_WORDS}, {O.MERGED} SELECT word, word_id FROM merged")
def merged_lexicon(spark, d):
    return lexicon.with_ids(merged_words(spark, d))


# indexes

_forward_html = f"""WITH {O.PAGES}, {O.LEXICON}, lex AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM html_lexicon),
w AS (SELECT DISTINCT doc_id, unnest(list_transform(toks, lambda x: replace(x, ',', '')) || {O.url_tokens('url')}) AS word FROM docs_h)
SELECT doc_id, array_to_string(list_sort(list(word_id)), ' ') AS word_ids FROM w JOIN lex USING (word) GROUP BY doc_id"""


@query("forward_index_html", _forward_html)
def forward_index_html(spark, d):
    return index.forward_lists(index.forward_index(index.html_doc_words(pages(spark, d)), html_lexicon(spark, d))).select("doc_id", joined("word_ids").alias("word_ids"))


_doc_words = f"lex AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM html_lexicon), w AS (SELECT DISTINCT doc_id, unnest(list_transform(toks, lambda x: replace(x, ',', '')) || {O.url_tokens('url')}) AS word FROM docs_h)"


def forward_html_ids(spark, d) -> tuple[DataFrame, DataFrame]:
    lex = html_lexicon(spark, d)
    return index.forward_index(index.html_doc_words(pages(spark, d)), lex), lex


@query("named_words", f"WITH {O.PAGES}, {O.LEXICON}, {_doc_words} SELECT doc_id, word FROM w JOIN lex USING (word)")
def named_words(spark, d):
    """The forward index with words in place of their numbers."""
    return index.word_names(*forward_html_ids(spark, d))


@query("first_documents", f"WITH {O.PAGES}, {O.LEXICON}, {_doc_words} SELECT doc_id, array_to_string(list_sort(list(word_id)), ' ') AS word_ids FROM w JOIN lex USING (word) GROUP BY doc_id ORDER BY doc_id LIMIT 100")
def first_documents(spark, d):
    return index.first_documents(forward_html_ids(spark, d)[0]).select("doc_id", joined("word_ids").alias("word_ids"))


@query(
    "forward_index_papers",
    f"WITH {O.PAPERS}, {O.PAPER_WORDS}, lex AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM paper_words)) SELECT doc_id, array_to_string(list_sort(list(word_id)), ' ') AS word_ids FROM paper_words JOIN lex USING (word) GROUP BY doc_id",
)
def forward_index_papers(spark, d):
    words = index.paper_doc_words(paper_docs(spark, d))
    return index.forward_lists(index.forward_index(words, lexicon.with_ids(lexicon.distinct_words(words)))).select("doc_id", joined("word_ids").alias("word_ids"))


@query("merge_forward", "SELECT l_orderkey AS doc_id, array_to_string(list_sort(list(l_partkey) FILTER (l_linenumber >= 3 OR NOT late)), ' ') AS word_ids FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) >= 3 AS late FROM lineitem) GROUP BY l_orderkey")
def merge_forward(spark, d):
    lines = table(spark, d, "lineitem")
    lists = lambda rows: index.forward_lists(rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("word_id")))
    return index.merge_forward(lists(lines.where("l_linenumber < 3")), lists(lines.where("l_linenumber >= 3"))).select("doc_id", joined("word_ids").alias("word_ids"))


@query(
    "inverted_html",
    f"WITH {O.PAGES}, {O.HTML_POSTINGS} SELECT word, doc_id, array_to_string(positions, ' ') AS positions, n_title, n_meta, n_heading, n_total, n_anchor, in_domain, in_url, doc_len FROM html_postings",
)
def inverted_html(spark, d):
    return index.html_postings(pages(spark, d)).select("word", "doc_id", joined("positions").alias("positions"), *numbers(*index.HTML_HITS))


@query("inverted_papers", f"WITH {O.PAPERS}, {O.PAPER_POSTINGS} SELECT word, doc_id, array_to_string(positions, ' ') AS positions, g1, g2, g3, n_total, doc_len FROM paper_postings")
def inverted_papers(spark, d):
    return index.paper_postings(paper_docs(spark, d)).select("word", "doc_id", joined("positions").alias("positions"), *numbers(*index.PAPER_HITS))


#: Which line of a document stands for which section here; the lines from the seventh on are the body.
SECTION_LINES = {"title": 0, "abstract": 1, "authors": 2, "bib": 3, "ref": 4, "back": 5}
_pt = lambda *lines: " || ".join(O.paper_tokens(f"l[{k}]") for k in lines)


@query(
    "inverted_paper_sections",
    f"""WITH s AS (SELECT 'P' || doc_id AS doc_id, {_pt(1, 2, 3)} AS head, {O.paper_tokens("array_to_string(l[7:], chr(10))")} AS body, {_pt(4, 5, 6)} AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, len(head) AS a, len(head) + len(body) AS b, len(head) + len(body) + len(tail) AS doc_len, unnest(head || body || tail) AS word, unnest(range(0, len(head) + len(body) + len(tail))) AS pos FROM s)
SELECT word, doc_id, array_to_string(list(pos ORDER BY pos)[1:15], ' ') AS positions, count(*) FILTER (pos < a) AS g1, count(*) FILTER (pos >= a AND pos < b) AS g2, count(*) FILTER (pos >= b) AS g3, count(*) AS n_total, any_value(doc_len) AS doc_len FROM h GROUP BY word, doc_id""",
)
def inverted_paper_sections(spark, d):
    """Postings of papers that have all their sections."""
    lines = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("P"), "doc_id").alias("doc_id"), F.split("text", "\n", -1).alias("l"))
    named = [F.coalesce(F.get("l", F.lit(k)), F.lit("")).alias(name) for name, k in SECTION_LINES.items()]
    rows = lines.select("doc_id", *named, F.array_join(F.slice("l", 7, F.greatest(F.size("l"), F.lit(1))), "\n").alias("body"))
    return index.paper_postings(rows).select("word", "doc_id", joined("positions").alias("positions"), *numbers(*index.PAPER_HITS))


@query(
    "inverted_html_lexicon",
    f"WITH {O.PAGES}, {O.HTML_POSTINGS}, {O.LEXICON} SELECT word, doc_id, n_total, doc_len FROM html_postings WHERE word IN (SELECT word FROM html_lexicon)",
)
def inverted_html_lexicon(spark, d):
    return index.html_postings(pages(spark, d), lexicon.html_lexicon(word_stats(spark, d))).select("word", "doc_id", *numbers("n_total", "doc_len"))


_anchored = f"""WITH {O.PAGES}, a AS (SELECT page_id, unnest(toks[1:3]) AS w FROM docs_h), texts AS (SELECT url, string_agg(w, ' ' ORDER BY w) AS t FROM a JOIN docs_h USING (page_id) GROUP BY url),
n AS (SELECT doc_id, word, count(*) AS n_anchor FROM (SELECT doc_id, unnest({O.tokens('t')}) AS word FROM docs_h JOIN texts USING (url)) GROUP BY doc_id, word)
SELECT doc_id, word, n_anchor FROM n WHERE word IN (SELECT unnest(toks || {O.url_tokens('url')} || {O.tokens(O.html_title('html'))}) FROM docs_h h WHERE h.doc_id = n.doc_id)"""


@query("inverted_html_anchors", _anchored)
def inverted_html_anchors(spark, d):
    p = pages(spark, d)
    linked = p.select(F.col("url").alias("to_url"), F.explode(F.slice(T.doc_tokens(T.html_text(F.col("html"))), 1, 3)).alias("anchor_text"))
    return index.html_postings(p, anchors=index.anchor_texts(linked)).where("n_anchor > 0").select("doc_id", "word", *numbers("n_anchor"))


def both_postings(spark, d):
    return index.drop_keys(index.html_postings(pages(spark, d)), index.HTML_HITS), index.drop_keys(index.paper_postings(paper_docs(spark, d)), index.PAPER_HITS)


_both = f"WITH {O.PAGES}, {O.PAPERS}, {O.HTML_POSTINGS}, {O.PAPER_POSTINGS}"


@query(
    "merged_postings",
    f"{_both} SELECT word, count(*) FILTER (doc_id LIKE 'H%') AS n_html, count(*) FILTER (doc_id LIKE 'P%') AS n_papers, md5(string_agg(doc_id || ':' || hits, ';' ORDER BY doc_id)) AS hits_md5 FROM (SELECT word, doc_id, array_to_string([n_title, n_meta, n_heading, n_total, n_anchor, in_domain, in_url, doc_len], ' ') AS hits FROM html_postings UNION ALL SELECT word, doc_id, array_to_string([g1, g2, g3, n_total, doc_len], ' ') FROM paper_postings) GROUP BY word",
)
def merged_postings(spark, d):
    lists = index.posting_lists(index.merge_postings(*both_postings(spark, d)))
    kind = lambda letter: F.size(F.filter("postings", lambda p: p["doc_id"].startswith(letter))).cast("long")
    hits = F.array_join(F.transform("postings", lambda p: F.concat(p["doc_id"], F.lit(":"), F.array_join(F.transform(p["hits"], lambda h: h.cast("string")), " "))), ";")
    return lists.select("word", kind("H").alias("n_html"), kind("P").alias("n_papers"), F.md5(hits).alias("hits_md5"))


@query("document_frequency", f"{_both} SELECT word, count(*) AS df FROM (SELECT word FROM html_postings UNION ALL SELECT word FROM paper_postings) GROUP BY word")
def document_frequency(spark, d):
    return index.document_frequency(index.merge_postings(*both_postings(spark, d)))


@query("first_postings", f"WITH {O.PAGES}, {O.HTML_POSTINGS} SELECT word, count(*) AS df FROM html_postings GROUP BY word ORDER BY word LIMIT 100")
def first_postings(spark, d):
    return index.first_postings(index.html_postings(pages(spark, d)))


@query("missing_ids", "SELECT i AS word_id FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders)) AS t(i) WHERE i % 3 = 0 OR i NOT IN (SELECT o_orderkey FROM orders)")
def missing_ids(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("word_id"))
    return index.missing_ids(ids.where("word_id % 3 <> 0"), ids.agg(F.max("word_id")).first()[0] + 1)


def paper_sizes(spark, d):
    return index.barrel_sizes(both_postings(spark, d)[1])


_sizes = f"""WITH RECURSIVE {O.PAPERS}, {O.PAPER_POSTINGS},
sizes AS (SELECT word, CAST(sum(length('{{"doc_id":"' || doc_id || '","positions":[' || array_to_string(positions, ',') || '],"hits":[' || array_to_string([g1, g2, g3, n_total, doc_len], ',') || ']}}')) + count(*) + 1 AS BIGINT) AS size
  FROM paper_postings GROUP BY word)"""


@query("barrel_sizes", f"{_sizes} SELECT word, size FROM sizes")
def barrel_sizes(spark, d):
    return paper_sizes(spark, d)


@query(
    "barrels",
    f"""{_sizes}, placed AS MATERIALIZED (SELECT word, size, row_number() OVER (ORDER BY word) AS k FROM sizes),
walk(k, barrel_id, "offset", used) AS (
  SELECT 0, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT p.k, CASE WHEN used + size >= 262144 THEN barrel_id + 1 ELSE barrel_id END, CASE WHEN used + size >= 262144 THEN 0 ELSE "offset" + 1 END, CASE WHEN used + size >= 262144 THEN size ELSE used + size END
  FROM walk JOIN placed p ON p.k = walk.k + 1)
SELECT word, barrel_id, "offset" FROM walk JOIN placed USING (k)""",
)
def barrels(spark, d):
    """Greedy barrels of the paper postings."""
    return index.barrels(paper_sizes(spark, d), limit=256 * 1024)


@query("even_barrels", f"WITH {O.PAPERS}, {O.PAPER_WORDS}, lex AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM paper_words)) SELECT word, word_id // 5000 AS barrel_id, word_id % 5000 AS \"offset\" FROM lex")
def even_barrels(spark, d):
    return index.even_barrels(lexicon.with_ids(distinct_words(spark, d)), 5000)


# links

_clean = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '#.*$', ''), '([?&])(ref|utm_source)=[^&]*', '\\1', 'g'), '&+$', ''), '\\?$', '')"
_links = f"""found AS (SELECT url, {O.decode('href')} AS href, trim({O.strip_tags('body')}) AS anchor_text FROM (
  SELECT url, unnest(regexp_extract_all(html, {O.q(T.ANCHOR)}, 1)) AS href, unnest(regexp_extract_all(html, {O.q(T.ANCHOR)}, 2)) AS body FROM pages) WHERE href <> ''),
links AS (SELECT * FROM (SELECT {_clean.format('url')} AS from_url, regexp_extract(url, '^[a-z]+://[^/]*') || href AS to_url, anchor_text FROM found) WHERE from_url <> to_url)"""


def all_links(spark, d):
    return links.without_garbage(links.page_links(pages(spark, d)))


@query("page_links", f"WITH {_links} SELECT * FROM links")
def page_links(spark, d):
    return all_links(spark, d)


@query("page_links_parser", f"WITH {_links} SELECT * FROM links")
def page_links_parser(spark, d):
    return links.page_links(pages(spark, d), strict_parser=True)


@query("links_in", f"WITH {_links} SELECT to_url, count(*) AS links FROM links GROUP BY to_url")
def links_in(spark, d):
    return links.link_counts(all_links(spark, d), "to_url")


@query("links_out", f"WITH {_links} SELECT from_url, count(*) AS links FROM links GROUP BY from_url")
def links_out(spark, d):
    return links.link_counts(all_links(spark, d), "from_url")


@query("link_ends", f"WITH {_links} SELECT from_url AS key FROM links UNION SELECT to_url FROM links")
def link_ends(spark, d):
    return links.distinct_ends(all_links(spark, d), "from_url", "to_url")


@query("anchor_texts", f"WITH {_links} SELECT to_url AS url, string_agg(anchor_text, ' ' ORDER BY anchor_text) AS anchor_text FROM links WHERE anchor_text <> '' GROUP BY to_url")
def anchor_texts(spark, d):
    return index.anchor_texts(all_links(spark, d))


#: Pages with links and addresses that cannot be read, and the rows that they give.
BROKEN_PAGES = [(-1, "http://[bad/x", '<a href="/a">a</a>'), (-2, "http://a.com/p", '<a href="http://[::1/y">b</a><a href="/ok">c</a>'), (-3, "http://b]c.org/", "<p>no link</p>"), (-4, "http://d.org/", '<a href="//e]f/g">h</a>')]
_errors = "('http://[bad/x', '/a'), ('http://a.com/p', 'http://[::1/y'), ('http://b]c.org/', NULL), ('http://d.org/', '//e]f/g')"


@query("link_errors", f"SELECT url, href, 'address cannot be parsed' AS error FROM (VALUES {_errors}) AS v(url, href)")
def link_errors(spark, d):
    """All pages, whose addresses are sound, and a few that are not."""
    p = pages(spark, d).select("page_id", "url", "html")
    return links.link_errors(p.union(spark.createDataFrame(BROKEN_PAGES, "page_id long, url string, html string")))


#: Addresses and what cleaning leaves of them.
CLEANED = [
    ("HTTP://a.com/p?x=1#top", "http://a.com/p?x=1"), ("http://a.com/p?x=&y=2", "http://a.com/p?y=2"), ("http://a.com/p?_own=1", "http://a.com/p"), ("http://a.com/?b=1&a=2&b=3", "http://a.com/?b=1&b=3&a=2"),
    ("http://a.com/p?q=a%20b", "http://a.com/p?q=a+b"), ("http://a.com?x=1", "http://a.com?x=1"), ("/p?x=1", "/p?x=1"), (" http://a.com/p\n", "http://a.com/p"),
]


@query(
    "cleaned_addresses",
    f"SELECT a, b FROM (VALUES {', '.join(f'({O.q(a)}, {O.q(b)})' for a, b in CLEANED)}) AS v(a, b) UNION ALL SELECT 'http://a.com/p?' || k || '=1&q=' || n_nationkey || '#f', 'http://a.com/p?q=' || n_nationkey FROM nation, (VALUES {', '.join(f'({O.q(k)})' for k in urls.TRACKING_KEYS)}) AS t(k)",
)
def cleaned_addresses(spark, d):
    """Addresses of every kind, and each nation's with each tracking key."""
    keys = F.explode(F.array(*[F.lit(k) for k in urls.TRACKING_KEYS])).alias("k")
    made = table(spark, d, "nation").select("n_nationkey", keys).select(F.concat(F.lit("http://a.com/p?"), "k", F.lit("=1&q="), "n_nationkey", F.lit("#f")).alias("a"))
    return spark.createDataFrame([(a,) for a, _ in CLEANED], "a string").union(made).select("a", urls.cleaned(F.col("a")).alias("b"))


_next = f"SELECT {O.domain('a.url')} AS from_domain, {O.domain('b.url')} AS to_domain FROM pages a JOIN pages b ON b.page_id = a.page_id + 1"


@query("domain_links", f"SELECT from_domain, to_domain FROM ({_next}) WHERE from_domain <> to_domain AND {O.valid_domain('from_domain')} AND {O.valid_domain('to_domain')}")
def domain_links(spark, d):
    a, b = pages(spark, d).select("page_id", F.col("url").alias("from_url")), pages(spark, d).select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("to_url"))
    return links.valid_domain_links(links.domain_links(a.join(b, "page_id")))


ADDRESSES = ["http://a.com/x", "mailto:a@b.c", "javascript:void(0)", "data:text/plain,x", "xmpp:a@b", "https://b.org", "a.com", "a b.com", "a:80", "localhost", "x.y/z", " "]
_addresses = ", ".join(f"({O.q(a)})" for a in ADDRESSES)


@query("address_filters", f"SELECT a, NOT regexp_matches(a, {O.q(urls.NOT_PAGES)}) AS is_page, {O.valid_domain('a')} AS is_domain FROM (VALUES {_addresses}) AS v(a)")
def address_filters(spark, d):
    return spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", urls.is_page(F.col("a")).alias("is_page"), urls.is_valid_domain(F.col("a")).alias("is_domain"))


def nation_citations(spark, d):
    """Each nation is a paper, its title made from its number; each trade is a citation."""
    n = lambda p: table(spark, d, "nation").select(F.col("n_nationkey").alias(f"{p}_key"), F.expr("concat('Nation ', char(97 + n_nationkey), ' [', n_name, ']')").alias(f"{p}_name"))
    rows = trades(spark, d).join(n("f"), F.col("src") == F.col("f_key")).join(n("t"), F.col("dst") == F.col("t_key"))
    flat = rows.select(F.col("f_key").alias("paper_id"), F.col("f_name").alias("title"), F.array("t_name").alias("bib_titles"))
    return links.citations(flat)


_cites = f"WITH {O.NATIONS} SELECT {O.normalise_title("'Nation ' || chr(97 + a.n_nationkey) || ' [' || a.n_name || ']'")} AS from_paper, {O.normalise_title("'Nation ' || chr(97 + b.n_nationkey) || ' [' || b.n_name || ']'")} AS to_paper FROM trades JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey"


@query("citation_counts", f"SELECT from_paper, to_paper, count(*) AS n FROM ({_cites}) GROUP BY from_paper, to_paper")
def citation_counts(spark, d):
    return nation_citations(spark, d).groupBy("from_paper", "to_paper").agg(F.count(F.lit(1)).alias("n"))


@query("most_cited", f"SELECT to_paper, count(*) AS citations FROM ({_cites}) GROUP BY to_paper ORDER BY citations DESC, to_paper LIMIT 10")
def most_cited(spark, d):
    return links.most_cited(nation_citations(spark, d))


@query("least_cited", f"SELECT to_paper, count(*) AS citations FROM ({_cites}) GROUP BY to_paper ORDER BY citations, to_paper LIMIT 10")
def least_cited(spark, d):
    return links.most_cited(nation_citations(spark, d), ascending=True)


@query("filled_titles", "SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE coalesce(c_name, '') END AS title FROM orders LEFT JOIN customer ON o_orderkey = c_custkey")
def filled_titles(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("title"))
    return links.with_titles(p, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")))


@query("known_papers", "SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def known_papers(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"))
    return links.known_papers(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), p)


# graph


def nation_nodes(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))


@query("pagerank_fixed", f"WITH {O.NATIONS}, {O.pagerank(6)} SELECT node, round(rank, 9) AS rank FROM r6")
def pagerank_fixed(spark, d):
    return graph.pagerank(trades(spark, d), nation_nodes(spark, d), fixed_iter=6).select("node", F.round("rank", 9).alias("rank"))


@query("pagerank_reversed", f"WITH t0 AS (WITH {O.NATIONS} SELECT * FROM trades), trades AS (SELECT dst AS src, src AS dst FROM t0), {O.pagerank(4)} SELECT node, round(rank, 9) AS rank FROM r4")
def pagerank_reversed(spark, d):
    return graph.pagerank(trades(spark, d), nation_nodes(spark, d), fixed_iter=4, reverse=True).select("node", F.round("rank", 9).alias("rank"))


@query("pagerank", f"WITH {O.NATIONS}, {O.pagerank(40)} SELECT node, round(rank, 7) AS rank FROM r40")
def pagerank(spark, d):
    """To convergence; forty rounds change nothing in seven places."""
    return graph.ranked(graph.pagerank(trades(spark, d), nation_nodes(spark, d)).select("node", F.round("rank", 7).alias("rank")))


@query(
    "decile_scores",
    "WITH o AS (SELECT c_custkey AS key, c_acctbal AS rank, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer) SELECT key, rank, CAST(10 - list_max(list_filter(range(0, 10), lambda i: CAST(floor(i * CAST(0.1 AS DOUBLE) * (n - 1)) AS BIGINT) <= place)) AS INTEGER) AS score FROM o",
)
def decile_scores(spark, d):
    return graph.decile_scores(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("rank")))


@query("encoded_links", f"WITH {_links} SELECT from_url AS a, to_url AS b, count(*) AS n FROM links GROUP BY from_url, to_url")
def encoded_links(spark, d):
    """Links through node numbers and back."""
    nodes, edges = graph.encode(all_links(spark, d), "from_url", "to_url")
    back = lambda c, name: nodes.select(F.col("id").alias(c), F.col("key").alias(name))
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(back("src", "a"), "src").join(back("dst", "b"), "dst").select("a", "b", "n")


@query(
    "page_scores",
    f"""WITH trades AS (WITH {_links} SELECT from_url AS src, to_url AS dst FROM links), {O.pagerank(5, "SELECT src FROM trades")}, o AS (SELECT node AS url, round(rank, 9) AS rank FROM r5),
p AS (SELECT *, row_number() OVER (ORDER BY rank DESC, url) - 1 AS place, count(*) OVER () AS n FROM o) SELECT url, rank, CAST(10 - list_max(list_filter(range(0, 10), lambda i: CAST(floor(i * CAST(0.1 AS DOUBLE) * (n - 1)) AS BIGINT) <= place)) AS INTEGER) AS score FROM p""",
)
def page_scores(spark, d):
    """Addresses scored by decile of their rank: numbers for addresses, ranks, addresses for numbers, scores."""
    nodes, edges = graph.encode(all_links(spark, d), "from_url", "to_url")
    ranks = graph.decode(graph.pagerank(edges, fixed_iter=5), nodes)
    return graph.decile_scores(ranks.select(F.col("key").alias("url"), F.round("rank", 9).alias("rank")), "url")


# search

SEARCHES = [(1, "the"), (2, "que"), (3, "of the"), (4, "und die"), (5, "unknownword the and"), (6, "the, and the"), (7, "example com"), (8, "nosuchword")]
_searches = f"queries AS (SELECT * FROM (VALUES {', '.join(f'({k}, {O.q(x)})' for k, x in SEARCHES)}) AS v(qid, query))"
_search = f"WITH {O.PAGES}, {O.PAPERS}, {O.HTML_POSTINGS}, {O.PAPER_POSTINGS}, {O.RANKS}, {O.POSTINGS}, {_searches}"


def search_inputs(spark, d) -> tuple[DataFrame, DataFrame, dict]:
    """Postings of the words asked for: other words of a document are dropped before anything is counted."""
    p, papers_ = pages(spark, d), paper_docs(spark, d)
    asked = search.query_words(search_queries(spark))
    postings = search.all_postings(index.html_postings(p, asked), index.paper_postings(papers_, asked))
    docs = p.select(F.concat(F.lit("H"), F.col("page_id")).alias("doc_id"), F.coalesce("url", F.lit("")).alias("url"), F.lit("").alias("title")).union(papers_.select("doc_id", F.lit(""), "title"))
    ranks = {
        "page_ranks": p.groupBy(F.col("url").alias("key")).agg(F.max(F.col("page_id") % 11).cast("int").alias("score")),
        "domain_ranks": p.select(urls.domain(F.col("url")).alias("key")).distinct().withColumn("score", (F.length("key") % 7).cast("int")),
        "citation_ranks": papers_.groupBy(T.normalise_title(F.col("title")).alias("key")).agg(F.max(search.number(F.col("doc_id")) % 5).cast("int").alias("score")),
    }
    return postings, docs, ranks


def search_queries(spark) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "qid int, query string")


@query("single_word_search", f"{_search} SELECT qid, doc_id, url, {O.SCORE} AS score FROM (SELECT qid, {O.query_tokens('query', False)}[1] AS word FROM queries) JOIN postings USING (word) JOIN doc_ranks USING (doc_id)".replace(f"{O.query_tokens('query', False)}[1]", f"({O.query_tokens('query', False)})[1]"))
def single_word_search(spark, d):
    postings, docs, ranks = search_inputs(spark, d)
    return search.single_word(search_queries(spark), postings, docs, **ranks)


@query("stored_search", ORACLES["single_word_search"])
def stored_search(spark, d):
    """The same search over an index of all words that was stored in barrels: the words' barrels are looked up."""
    _, docs, ranks = search_inputs(spark, d)
    postings = search.all_postings(index.html_postings(pages(spark, d)), index.paper_postings(paper_docs(spark, d)))
    path = shared_path(spark, "stored-index")
    placed = index.even_barrels(lexicon.with_ids(postings.select("word").distinct()), 5000)
    writers.barrels(postings, placed, path)
    stored = readers.barrels(spark, path)
    found = search.lookup(search_queries(spark), stored.select("word", "barrel_id").distinct(), stored)
    return search.single_word(search_queries(spark), found, docs, **ranks)


_hits = f"""{_search}, terms AS (SELECT qid, unnest({O.query_tokens('query', True)}) AS word, unnest(range(0, len({O.query_tokens('query', True)}))) AS term FROM queries),
hits AS (SELECT * FROM terms JOIN postings USING (word)),
known AS (SELECT qid, count(DISTINCT term) AS known FROM hits GROUP BY qid),
full_docs AS (SELECT qid, doc_id FROM hits JOIN known USING (qid) GROUP BY qid, doc_id HAVING count(*) = any_value(known))"""


@query(
    "multi_word_search",
    f"""{_hits}, scored AS (SELECT qid, doc_id, url, positions, {O.SCORE} AS score FROM hits JOIN full_docs USING (qid, doc_id) JOIN doc_ranks USING (doc_id)),
g AS (SELECT qid, doc_id, any_value(url) AS url, avg(score) AS avg_word_score, list_sort(flatten(list(positions))) AS p FROM scored GROUP BY qid, doc_id),
c AS (SELECT *, len(list_filter(range(2, len(p) + 1), lambda i: p[i] - p[i - 1] <= 2)) AS close_matches FROM g)
SELECT qid, doc_id, round(close_matches + avg_word_score, 6) AS combined_score, round(avg_word_score, 6) AS avg_word_score, close_matches, coalesce(list_max(p) - list_min(p), 0) AS cluster_range, url, array_to_string(p, ' ') AS positions FROM c""",
)
def multi_word_search(spark, d):
    postings, docs, ranks = search_inputs(spark, d)
    out = search.multi_word(search_queries(spark), postings, docs, **ranks)
    return out.select("qid", "doc_id", F.round("combined_score", 6).alias("combined_score"), F.round("avg_word_score", 6).alias("avg_word_score"), *numbers("close_matches", "cluster_range"), "url", joined("positions").alias("positions"))


_closest = ORACLES["multi_word_search"]
_closest = f"{_closest[: _closest.rindex('SELECT qid, doc_id, round')]} SELECT qid, doc_id, close_matches, place FROM (SELECT qid, doc_id, close_matches, row_number() OVER (PARTITION BY qid ORDER BY close_matches DESC, doc_id[1], CAST(doc_id[2:] AS BIGINT)) AS place FROM c) WHERE place <= 15"


@query("closest_first", _closest)
def closest_first(spark, d):
    """The fifteen documents of each query with most close matches."""
    postings, docs, ranks = search_inputs(spark, d)
    return search.closest_first(search.multi_word(search_queries(spark), postings, docs, **ranks)).select("qid", "doc_id", *numbers("close_matches", "place"))


@query("matching_documents", f"{_hits} SELECT qid, doc_id FROM full_docs")
def matching_documents(spark, d):
    return search.matching(search_queries(spark), search_inputs(spark, d)[0], ["doc_id"]).select("qid", "doc_id")


@query(
    "closest_cluster",
    f"""{_hits}, l AS (SELECT qid, doc_id, list(positions ORDER BY term) AS lists FROM hits JOIN full_docs USING (qid, doc_id) GROUP BY qid, doc_id),
s AS (SELECT qid, doc_id, lists, unnest(list_distinct(flatten(lists))) AS v FROM l),
w AS (SELECT qid, doc_id, v, list_max(list_transform(lists, lambda own: list_min(list_filter(own, lambda y: y >= v)))) - v AS width, len(list_filter(lists, lambda own: len(list_filter(own, lambda y: y >= v)) = 0)) AS lacking FROM s)
SELECT qid, doc_id, min(v) AS begin_at, any_value(width) AS width FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY width, v) AS k FROM w WHERE lacking = 0) WHERE k = 1 GROUP BY qid, doc_id""",
)
def closest_cluster(spark, d):
    found = search.matching(search_queries(spark), search_inputs(spark, d)[0], ["doc_id", "positions"])
    lists = F.transform("hits", lambda h: h["positions"])
    return found.select("qid", "doc_id", scoring.closest_cluster(lists).alias("c")).where("c is not null").select("qid", "doc_id", F.col("c.begin").cast("long").alias("begin_at"), F.col("c.width").cast("long").alias("width"))


@query(
    "reduced_search",
    f"WITH {O.PAGES}, {O.HTML_POSTINGS}, {_searches} SELECT qid, doc_id, round(least(80, greatest(1, least(7.5 * n_title, 15) + least(3 * n_heading, 9) + least(2 * n_meta, 6) + least(7 * ln(1 + greatest(0, n_total - (n_title + n_heading + n_meta))), 20))), 6) AS score FROM (SELECT qid, ({O.query_tokens('query', False)})[1] AS word FROM queries) JOIN html_postings USING (word)",
)
def reduced_search(spark, d):
    return search.reduced_search(search_queries(spark), index.html_postings(pages(spark, d))).select("qid", "doc_id", F.round("score", 6).alias("score"))


# papers and figures

_lines = "lines AS (SELECT doc_id, pos, line AS text, CASE WHEN pos % 4 = 3 THEN '' ELSE 'S' || (pos // 3) END AS section FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
_last = f"{_lines}, marked AS (SELECT *, coalesce(last_value(CASE WHEN trim(text) <> '' AND section <> '' THEN section END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS last_section FROM lines)"


def document_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", F.when(F.col("pos") % 4 == 3, "").otherwise(F.concat(F.lit("S"), F.expr("cast(pos div 3 as string)"))).alias("section"))


@query("last_sections", f"WITH {_last} SELECT doc_id, pos, section, last_section, md5(text) AS text_md5 FROM marked")
def last_sections(spark, d):
    return index.last_section(document_lines(spark, d)).select("doc_id", "pos", "section", "last_section", F.md5("text").alias("text_md5"))


@query(
    "marked_sections",
    f"WITH {_last} SELECT doc_id, md5(coalesce(string_agg(CASE WHEN section <> '' AND section <> last_section THEN '%' || section || '%' || chr(10) ELSE '' END || text, chr(10) ORDER BY pos) FILTER (trim(text) <> ''), '')) AS body_md5 FROM marked GROUP BY doc_id",
)
def marked_sections(spark, d):
    rows = document_lines(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "section"))), lambda x: F.struct(x["text"].alias("text"), x["section"].alias("section"))).alias("p"))
    return rows.select("doc_id", F.md5(F.array_join(papers.marked_sections(F.col("p")), "\n")).alias("body_md5"))


@query(
    "timing_stats",
    "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS deviation, list_sort(list(value))[count(*) // 2 + 1] AS median, count(*) AS runs FROM events GROUP BY event_type",
)
def timing_stats(spark, d):
    out = stats.timing_stats(table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), "least", "most", F.round("deviation", 6).alias("deviation"), "median", "runs")


@query(
    "size_totals",
    "SELECT source, count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(avg(strlen(text)), 6) AS mean_bytes, round(sum(strlen(text)) / CAST((SELECT sum(strlen(text)) FROM documents) AS DOUBLE), 9) AS part FROM documents GROUP BY source",
)
def size_totals(spark, d):
    out = stats.size_totals(table(spark, d, "documents").select("source", F.octet_length("text").alias("size")), "source")
    return out.select("source", "entries", "bytes", F.round("mean_bytes", 6).alias("mean_bytes"), F.round("part", 9).alias("part"))


# sources and sinks: written to the shared folder and read again


@query("csv_round_trip", "SELECT c_custkey, c_name || ' \"' || c_mktsegment || '\", x' AS label, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('", x')).alias("label"), "c_acctbal")
    writers.csv(rows, path := shared_path(spark, "csv"))
    return readers.csv(spark, path, "c_custkey long, label string, c_acctbal double")


@query("edge_csv", "SELECT l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber <> 2")
def edge_csv(spark, d):
    """Edges with spaces around the numbers; a second end that is no number drops its line."""
    dst = F.when(F.col("l_linenumber") == 2, "none").otherwise(F.concat(F.lit(" "), "l_suppkey", F.lit(" ")))
    writers.csv(table(spark, d, "lineitem").select(F.concat("l_orderkey", F.lit(" ")).alias("from"), dst.alias("to")), path := shared_path(spark, "edges"))
    return readers.edges(spark, path)


@query("json_map_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS value FROM part")
def json_map_round_trip(spark, d):
    writers.json_object(table(spark, d, "part"), "p_partkey", "p_name", path := shared_path(spark, "map"), parts=4)
    return readers.json_map(spark, path, lines=True)


@query("json_lines_round_trip", "SELECT o_orderkey, o_orderpriority FROM orders")
def json_lines_round_trip(spark, d):
    writers.json(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path := shared_path(spark, "lines"))
    return readers.json_lines(spark, path, "o_orderkey long, o_orderpriority string")


@query("word_list_round_trip", f"WITH {O.PAGES}, {O.LEXICON} SELECT word FROM html_lexicon")
def word_list_round_trip(spark, d):
    writers.word_list(lexicon.html_lexicon(word_stats(spark, d)), path := shared_path(spark, "words"))
    return readers.words(spark, path)


@query("barrel_round_trip", f"WITH {O.PAGES}, {O.HTML_POSTINGS} SELECT word, doc_id, n_total FROM html_postings")
def barrel_round_trip(spark, d):
    """Postings stored in barrels of one size and stored again in barrels of another."""
    postings = index.html_postings(pages(spark, d))
    ids = lexicon.with_ids(postings.select("word").distinct())
    writers.barrels(postings, index.even_barrels(ids, 2000), first := shared_path(spark, "barrels"))
    writers.barrels(readers.barrels(spark, first).drop("barrel_id", "offset"), index.even_barrels(ids, 5000), second := shared_path(spark, "barrels"))
    return readers.barrels(spark, second).select("word", "doc_id", *numbers("n_total"))


@query("renumbered_files", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS new_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def renumbered_files(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"))
    return readers.renumbered(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), files)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen best pages for the most frequent word of the pages."""
    postings = index.html_postings(pages(spark, d))
    word = index.document_frequency(postings).orderBy(F.desc("df"), "word").first()["word"]
    one = spark.createDataFrame([(1, word)], "qid int, query string")
    docs = pages(spark, d).select(F.concat(F.lit("H"), F.col("page_id")).alias("doc_id"), "url", F.lit("").alias("title"))
    return search.top(search.single_word(one, search.all_postings(postings, None), docs))
