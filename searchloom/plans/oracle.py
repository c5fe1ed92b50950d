"""SQL fragments of the operators' meaning, for engines with RE2 expressions and lambda lists."""

from __future__ import annotations

from searchloom.functions import text as T
from searchloom.functions import urls


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def gsub(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, 'g')"


def decode(e: str) -> str:
    for ref, char in T.ENTITIES:
        e = f"replace({e}, {q(ref)}, {q(char)})"
    return e


def strip_tags(e: str) -> str:
    return decode(gsub(e, T.TAG, ""))


def html_text(e: str) -> str:
    for p in (T.COMMENT, T.SCRIPT, T.STYLE):
        e = gsub(e, p, "")
    return strip_tags(e)


def html_title(e: str) -> str:
    return strip_tags(f"regexp_extract({e}, {q(T.TITLE)}, 1)")


def description(e: str) -> str:
    return decode(f"coalesce(list_filter(list_transform(regexp_extract_all({e}, {q(T.DESCRIPTION)}), lambda t: regexp_extract(t, {q(T.CONTENT)}, 1)), lambda t: t <> '')[1], '')")


def headings(e: str) -> str:
    return f"list_transform(regexp_extract_all({e}, {q(T.HEADING)}, 1), lambda t: {strip_tags('t')})"


def tokens(e: str, pattern: str = T.DOC_TOKEN) -> str:
    return f"list_transform(regexp_extract_all(coalesce({e}, ''), {q(pattern)}), lambda w: lower(w))"


def paper_tokens(e: str) -> str:
    return tokens(e, T.PAPER_TOKEN)


def query_tokens(e: str, join_punctuation: bool) -> str:
    if join_punctuation:
        mark = T.MARK
        for _ in range(2):
            e = gsub(e, rf"({T.DIGIT})({T.QUERY_PUNCT})({T.DIGIT})", rf"\1{mark}\2\3")
        e = gsub(gsub(e, rf"({mark}{T.QUERY_PUNCT})|{T.QUERY_PUNCT}", r"\1"), mark, "")
        words = f"string_split(trim({gsub(e, rf'[{T.SPACES}]+', ' ')}), ' ')"
    else:
        words = f"regexp_extract_all({e}, {q(T.DOC_TOKEN)})"
    words = f"list_transform({words}, lambda w: lower({gsub('w', T.BRACKETS, '')}))"
    return f"CASE WHEN len({words}) = 0 THEN [''] ELSE {words} END"


def strict_words(e: str) -> str:
    e = gsub(gsub(e, T.STRICT_TAG, ""), "'[sS]", "'")
    return f"list_filter(list_transform(regexp_extract_all({e}, '[A-Za-z]+'), lambda w: lower(w)), lambda w: length(w) BETWEEN 4 AND 14 AND regexp_matches(w, '[aeiouy]') AND NOT regexp_matches(w, '[^aeiouy]{{4}}'))"


def url_tokens(e: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]+')), lambda w: w NOT IN ('www', 'http', 'https'))"


def domain(e: str) -> str:
    return f"regexp_extract(coalesce({e}, ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"


def path(e: str) -> str:
    return f"regexp_extract(coalesce({e}, ''), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def normalise_title(e: str) -> str:
    return f"trim({gsub(gsub(f'lower(coalesce({e}, {q('')}))', T.BRACKETED, ' '), '[^a-z]+', ' ')})"


def clean_title(e: str) -> str:
    parts = f"string_split_regex(coalesce({e}, ''), '[.,]')"
    return f"trim(list_reduce({parts}, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END))"


def valid_domain(e: str) -> str:
    return f"({e} IS NOT NULL AND trim({e}) <> '' AND NOT regexp_matches({e}, {q(urls.DOMAIN_MARKS)}) AND contains({e}, '.'))"


EARLY = "CASE WHEN len(positions) > 0 THEN 15 - least(positions[1] // {step}, {most}) ELSE 0 END"
HTML_RAW = (
    "(least(7.5 * n_title, 15) + 10 * in_domain + 5 * in_url + least(3 * n_heading, 9) + least(2 * n_meta, 6) + "
    + EARLY.format(step=7, most=15)
    + " + least(7 * ln(1 + greatest(0, n_total - (n_title + n_heading + n_meta))), 20)) * (1 - CAST(n_total AS DOUBLE) / CASE WHEN doc_len > 0 THEN doc_len ELSE 1 END)"
)
PAPER_RAW = (
    "(least(5 * g1, 35) + " + EARLY.format(step=15, most=10) + " + least(10 * ln(1 + g2 + CAST(0.1 AS DOUBLE) * g3), 40)) * (1 - CAST(n_total AS DOUBLE) / CASE WHEN doc_len > 0 THEN doc_len ELSE 1 END)"
)
SCORE = (
    f"CAST(trunc(CASE WHEN doc_id LIKE 'H%' THEN least(80, greatest(1, {HTML_RAW})) + page_rank + domain_rank ELSE least(80, greatest(1, {PAPER_RAW})) + citation_rank END) AS INTEGER)"
)

#: Common tables: pages and papers with tokens, and their postings.
PAGES = f"""
docs_h AS (SELECT 'H' || page_id AS doc_id, page_id, coalesce(url, '') AS url, html, {tokens(html_text('html'))} AS toks FROM pages)"""
PAPERS = f"""
docs_p0 AS (SELECT 'P' || doc_id AS doc_id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents),
docs_p AS (SELECT *, {paper_tokens('title')} AS t_title, {paper_tokens('body')} AS t_body FROM docs_p0)"""
HTML_POSTINGS = f"""
zones AS (
  SELECT doc_id, unnest(toks) AS word, unnest(range(0, len(toks))) AS pos, 'total' AS zone FROM docs_h
  UNION ALL SELECT doc_id, unnest({tokens(html_title('html'))}), NULL, 'title' FROM docs_h
  UNION ALL SELECT doc_id, unnest({tokens(description('html'))}), NULL, 'meta' FROM docs_h
  UNION ALL SELECT doc_id, unnest(flatten(list_transform({headings('html')}, lambda h: {tokens('h')}))), NULL, 'heading' FROM docs_h
  UNION ALL SELECT doc_id, unnest({url_tokens('url')}), NULL, 'url' FROM docs_h),
counted AS (
  SELECT doc_id, word, coalesce(list(pos ORDER BY pos) FILTER (pos IS NOT NULL), [])[1:15] AS positions, count(*) FILTER (zone = 'title') AS n_title, count(*) FILTER (zone = 'meta') AS n_meta,
    count(*) FILTER (zone = 'heading') AS n_heading, count(*) FILTER (zone = 'total') AS n_total FROM zones GROUP BY doc_id, word),
html_postings AS (
  SELECT word, doc_id, positions, n_title, n_meta, n_heading, n_total, 0 AS n_anchor, CAST(contains({domain('url')}, word) AS INTEGER) AS in_domain,
    CAST(contains({path('url')}, word) AS INTEGER) AS in_url, greatest(len(toks), 1) AS doc_len FROM counted JOIN docs_h USING (doc_id))"""
PAPER_POSTINGS = """
paper_hits AS (
  SELECT doc_id, unnest(t_title) AS word, unnest(range(0, len(t_title))) AS pos, 1 AS g FROM docs_p
  UNION ALL SELECT doc_id, unnest(t_body), unnest(range(len(t_title), len(t_title) + len(t_body))), 2 FROM docs_p),
paper_postings AS (
  SELECT word, doc_id, list(pos ORDER BY pos)[1:15] AS positions, count(*) FILTER (g = 1) AS g1, count(*) FILTER (g = 2) AS g2, 0 AS g3, count(*) AS n_total, any_value(len(t_title) + len(t_body)) AS doc_len
  FROM paper_hits JOIN docs_p USING (doc_id) GROUP BY word, doc_id)"""
LEXICON = f"""
page_words AS (SELECT {domain('url')} AS domain, unnest(toks) AS word FROM docs_h),
stats AS (SELECT word, count(*) AS freq, count(DISTINCT domain) AS n_domains FROM page_words WHERE word <> '' GROUP BY word),
plain AS (SELECT word FROM stats WHERE length(word) <= 20 AND regexp_matches(word, '^[\\p{{L}}\\p{{N}}]+$')
  AND (freq >= 50 OR (freq >= 5 AND n_domains >= 2) OR (freq >= 3 AND length(word) < 8))),
pool AS (SELECT * FROM stats WHERE length(word) <= 10 AND NOT regexp_matches(word, '^[\\p{{L}}\\p{{N}}]+$') AND NOT starts_with(word, 'www') AND NOT starts_with(word, 'http')
  AND NOT contains(word, '(') AND NOT contains(word, ')') AND n_domains > 1),
rest AS (SELECT DISTINCT replace(word, ',', '') AS word FROM pool WHERE freq >= 10 OR (freq >= 5 AND n_domains >= 2)),
html_lexicon AS (SELECT word FROM plain UNION SELECT word FROM rest WHERE word <> '')"""
PAPER_WORDS = """
paper_words AS (SELECT DISTINCT doc_id, unnest(t_title || t_body) AS word FROM docs_p)"""
MERGED = """
merged AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT word FROM html_lexicon UNION SELECT word FROM paper_words))"""
#: A graph with repeated edges: from the customer's nation to the supplier's.
NATIONS = """
trades AS (
  SELECT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey)"""


def pagerank(iterations: int, isolated: str = "SELECT n_nationkey FROM nation") -> str:
    """Unrolled rounds over ``trades``, from ``r0``; ``isolated`` gives nodes that need no edge."""
    parts = [
        f"nodes AS (SELECT DISTINCT node FROM (SELECT src AS node FROM trades UNION ALL SELECT dst FROM trades UNION ALL {isolated}))",
        "links AS (SELECT src, dst, count(*) / CAST(sum(count(*)) OVER (PARTITION BY src) AS DOUBLE) AS share FROM trades GROUP BY src, dst)",
        "r0 AS (SELECT node, CAST(1 AS DOUBLE) / (SELECT count(*) FROM nodes) AS rank FROM nodes)",
    ]
    for k in range(iterations):
        parts.append(f"""r{k + 1} AS (SELECT node, (1 - CAST(0.85 AS DOUBLE)) / (SELECT count(*) FROM nodes) + CAST(0.85 AS DOUBLE) * (coalesce(got, 0)
          + coalesce((SELECT sum(rank) FROM r{k} WHERE node NOT IN (SELECT src FROM links)), 0) / (SELECT count(*) FROM nodes)) AS rank
          FROM nodes LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM links JOIN r{k} ON src = node GROUP BY dst) ON node = dst)""")
    return ", ".join(parts)


RANKS = f"""
page_ranks AS (SELECT url AS key, CAST(max(page_id % 11) AS INTEGER) AS score FROM pages GROUP BY url),
domain_ranks AS (SELECT DISTINCT {domain('url')} AS key, CAST(length({domain('url')}) % 7 AS INTEGER) AS score FROM pages),
citation_ranks AS (SELECT {normalise_title('title')} AS key, CAST(max(CAST(substr(doc_id, 2) AS BIGINT) % 5) AS INTEGER) AS score FROM docs_p0 GROUP BY 1)"""
POSTINGS = f"""
postings AS (
  SELECT word, doc_id, positions, n_title, n_meta, n_heading, n_total, in_domain, in_url, NULL AS g1, NULL AS g2, NULL AS g3, doc_len FROM html_postings
  UNION ALL SELECT word, doc_id, positions, NULL, NULL, NULL, n_total, NULL, NULL, g1, g2, g3, doc_len FROM paper_postings),
known_docs AS (SELECT doc_id, url, '' AS title FROM docs_h UNION ALL SELECT doc_id, '', title FROM docs_p0),
doc_ranks AS (
  SELECT doc_id, url, coalesce(p.score, 0) AS page_rank, coalesce(d.score, 0) AS domain_rank, coalesce(c.score, 0) AS citation_rank
  FROM known_docs LEFT JOIN page_ranks p ON url = p.key LEFT JOIN domain_ranks d ON {domain('url')} = d.key LEFT JOIN citation_ranks c ON {normalise_title('title')} = c.key)"""
