"""Addresses as columns: parts, resolving and cleaning, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that carry no content.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "referrer", "external_link"]
# Schemes of addresses that are not pages.
NOT_PAGES = r"^(data|javascript|mailto|xmpp):"
DOMAIN_MARKS = r"[/\\:?#\[\]@!$&'()*+,;= ]"
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
#: scheme, authority, path, query, fragment: any text has all five, each possibly empty.
PARTS = rf"(?s)^(?:({SCHEME}):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
#: An authority in which a square bracket is not part of an address in brackets.
BROKEN_BRACKETS = r"^(?=.*[\[\]])(?!//(?:[^@\[\]]*@)?\[[0-9A-Fa-f:.vV]+\](?::\d*)?$)"


def domain(url: Column) -> Column:
    """Host and port as written; empty if there are none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), rf"^{SCHEME}://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), rf"^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_page(url: Column) -> Column:
    return url.isNotNull() & ~url.rlike(NOT_PAGES)


def is_valid_domain(name: Column) -> Column:
    """Not blank, without space or any of the marks of an address, with a full stop."""
    return name.isNotNull() & (F.trim(name) != "") & ~name.rlike(DOMAIN_MARKS) & name.contains(".")


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def _plain(url: Column) -> Column:
    """Without the characters that an address cannot have around or inside it."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _query_text(x: Column) -> Column:
    """A key or value decoded and encoded again, so that equal ones are written in one way."""
    odd = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.replace(F.replace(F.url_encode(F.url_decode(odd)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    """Pairs that have a value and whose key is neither for tracking nor private; pairs of one key stand where its first one is."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)=.")),
        lambda p: F.struct(_query_text(F.substring_index(p, "=", 1)).alias("key"), _query_text(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")),
    )
    kept = F.filter(pairs, lambda p: ~p["key"].startswith("_") & ~p["key"].isin(TRACKING_KEYS))
    of_key = lambda key: F.filter(kept, lambda p: p["key"] == key)
    grouped = F.flatten(F.transform(F.array_distinct(F.transform(kept, lambda p: p["key"])), of_key))
    return F.array_join(F.transform(grouped, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def cleaned(url: Column) -> Column:
    """Without fragment, blank parameters, tracking keys and keys that begin with an underscore; null for a broken authority."""
    u = _plain(url)
    scheme, host, query = F.lower(_part(u, 1)), _part(u, 2), F.when(_part(u, 4) != "", _clean_query(F.substring(_part(u, 4), 2, 1 << 30))).otherwise("")
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "//", host).otherwise(""), _part(u, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(~host.rlike(BROKEN_BRACKETS), out)


def _without_dots(path: Column) -> Column:
    """A path from the root with its . and .. steps carried out."""
    steps = F.split(path, "/", -1)
    last = F.element_at(steps, -1)
    walk = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda at, s: F.when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when(s == ".", at).otherwise(F.concat(at, F.array(s))),
    )
    ends = F.when(last.isin(".", ".."), F.concat(walk, F.array(F.lit("")))).otherwise(walk)
    return F.regexp_replace(F.array_join(ends, "/"), "^(?!/)", "/")


def resolved(base: Column, href: Column) -> Column:
    """The clean absolute address of a link on the page ``base``; null where there is none."""
    b, h = _plain(base), _plain(href)
    b_scheme, h_scheme = F.lower(_part(b, 1)), F.lower(_part(h, 1))
    origin = F.concat(b_scheme, F.lit(":"), _part(b, 2))
    h_host, h_path, h_query = _part(h, 2), _part(h, 3), F.when(F.length(_part(h, 4)) > 1, _part(h, 4)).otherwise("")
    folder = F.regexp_extract(_part(b, 3), "(?s)^(.*/)", 1)
    joined = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), h_path), "/{2,}", "/")
    target = (
        F.when((b == "") | (h_scheme != "") & (h_scheme != b_scheme), h)
        .when(h_host != "", F.concat(b_scheme, F.lit(":"), h_host, h_path, h_query))
        .when(h_path == "", F.concat(origin, _part(b, 3), F.when(h_query != "", h_query).otherwise(_part(b, 4))))
        .otherwise(F.concat(origin, _without_dots(F.when(h_path.startswith("/"), h_path).otherwise(joined)), h_query))
    )
    return F.when(~_part(b, 2).rlike(BROKEN_BRACKETS) & ~h_host.rlike(BROKEN_BRACKETS), cleaned(target))
