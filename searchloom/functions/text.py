"""Text normalisation as columns: HTML fields, four tokenizers, titles, word rules. Patterns have no look-around
and no engine-specific classes, so they mean the same in other regular-expression engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
SPACES = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PUNCT = rf"[^\p{{L}}\p{{N}}_{SPACES}]"
#: Words; a punctuation mark stays between two digits.
DOC_TOKEN = rf"{WORD}*{DIGIT}(?:{PUNCT}(?:{DIGIT}{WORD}*{DIGIT}|{DIGIT}))*{PUNCT}{DIGIT}{WORD}*|{WORD}+"
#: Runs of ASCII letters and digits and of all characters beyond ASCII.
PAPER_TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
MARK = "\x01"  # stands for a kept punctuation mark while others are dropped
QUERY_PUNCT = rf"[^\p{{L}}\p{{N}}_\x01{SPACES}]"
BRACKETS = r"[,()\[\]{}]"
BRACKETED = r"\(.*?\)|\[.*?\]|\{.*?\}|<.*?>"

COMMENT, SCRIPT, STYLE, TAG = r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
HEADING = r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]"
DESCRIPTION = r"""(?is)<meta\b[^>]*\bname=["']?description\b[^>]*>"""
CONTENT = r"""(?is)\bcontent=["']([^"']*)["']"""
ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a"""
STRICT_TAG = r"<[^>]*(?:>|$)|>"

# Character references that are decoded; the ampersand comes last.
ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode(text: Column) -> Column:
    for ref, char in ENTITIES:
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    return decode(F.regexp_replace(html, TAG, ""))


def html_text(html: Column) -> Column:
    """All text outside scripts, styles and comments, joined without separators."""
    for pattern in (COMMENT, SCRIPT, STYLE):
        html = F.regexp_replace(html, pattern, "")
    return strip_tags(html)


def html_title(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, TITLE, 1))


def html_description(html: Column) -> Column:
    """Content of the first description tag that has some; empty without one."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(DESCRIPTION), 0), lambda t: F.regexp_extract(t, CONTENT, 1))
    return decode(F.coalesce(F.try_element_at(F.filter(tags, lambda t: t != ""), F.lit(1)), F.lit("")))


def html_headings(html: Column) -> Column:
    """Texts of all headings, h1 to h6."""
    return F.transform(F.regexp_extract_all(html, F.lit(HEADING), 1), strip_tags)


def html_anchors(html: Column) -> Column:
    """array<struct<href, text>> of all links that have an address."""
    href = F.regexp_extract_all(html, F.lit(ANCHOR), 1)
    text = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), 2), lambda t: F.trim(strip_tags(t)))
    return F.filter(F.arrays_zip(F.transform(href, decode).alias("href"), text.alias("text")), lambda x: x["href"] != "")


def _tokens(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0), lambda x: F.lower(x))


def doc_tokens(text: Column) -> Column:
    return _tokens(text, DOC_TOKEN)


def paper_tokens(text: Column) -> Column:
    return _tokens(text, PAPER_TOKEN)


def query_tokens(query: Column, join_punctuation: bool) -> Column:
    """Tokens of a search query. ``join_punctuation``: marks inside words vanish; else they part words. Never empty: without a word, one empty token."""
    if join_punctuation:
        q = query
        for _ in range(2):  # overlapping digit-mark-digit triples
            q = F.regexp_replace(q, rf"({DIGIT})({QUERY_PUNCT})({DIGIT})", f"$1{MARK}$2$3")
        q = F.regexp_replace(F.regexp_replace(q, rf"({MARK}{QUERY_PUNCT})|{QUERY_PUNCT}", "$1"), MARK, "")
        words = F.split(F.trim(F.regexp_replace(q, rf"[{SPACES}]+", " ")), " ")
    else:
        words = F.regexp_extract_all(query, F.lit(DOC_TOKEN), 0)
    words = F.transform(words, lambda w: F.lower(F.regexp_replace(w, BRACKETS, "")))
    return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)


def strict_words(html: Column) -> Column:
    """Letters-only words of a page: tags vanish without parting words, an s after an apostrophe is skipped."""
    text = F.regexp_replace(F.regexp_replace(html, STRICT_TAG, ""), "'[sS]", "'")
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0), lambda w: F.lower(w))
    return F.filter(words, is_strict_word)


def is_strict_word(word: Column) -> Column:
    """4 to 14 letters, a vowel or y, and no four consonants in a row."""
    return F.length(word).between(4, 14) & word.rlike("[aeiouy]") & ~word.rlike("[^aeiouy]{4}")


def url_tokens(url: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(r"[\p{L}\p{N}_]+"), 0))
    return F.array_except(words, F.array(F.lit("www"), F.lit("http"), F.lit("https")))


def normalise_title(title: Column) -> Column:
    """Lower case, letters a-z only, bracketed parts and all other characters as spaces, single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), BRACKETED, " ")
    return F.trim(F.regexp_replace(t, "[^a-z]+", " "))


def clean_title(title: Column) -> Column:
    """The longest part between full stops and commas; of equal ones the first."""
    parts = F.split(F.coalesce(title, F.lit("")), "[.,]")
    best = F.aggregate(parts, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    return F.trim(best)
