"""Relevance of one hit, and nearness of several words, as columns. Weights and limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _early(positions: Column, step: int, most: int) -> Column:
    """15 less one for each ``step`` words before the first position, down by ``most`` at the most; 0 without positions."""
    first = F.try_element_at(positions, F.lit(1))
    return F.when(first.isNotNull(), 15 - F.least(F.floor(first / step), F.lit(most))).otherwise(F.lit(0)).cast("double")


def html_score(title: Column, meta: Column, heading: Column, total: Column, in_domain: Column, in_url: Column, doc_len: Column, positions: Column, page_rank: Column, domain_rank: Column) -> Column:
    s = F.least(7.5 * title, F.lit(15.0)) + 10 * in_domain + 5 * in_url + F.least(3 * heading, F.lit(9)) + F.least(2 * meta, F.lit(6))
    s = s + _early(positions, 7, 15)
    s = s + F.least(7 * F.ln(1 + F.greatest(F.lit(0), total - (title + heading + meta))), F.lit(20.0))
    s = s * (1 - total / F.when(doc_len > 0, doc_len).otherwise(F.lit(1)))
    return (F.least(F.lit(80.0), F.greatest(F.lit(1.0), s)) + page_rank + domain_rank).cast("int")


def paper_score(g1: Column, g2: Column, g3: Column, total: Column, doc_len: Column, positions: Column, citation_rank: Column) -> Column:
    s = F.least(5 * g1, F.lit(35)) + _early(positions, 15, 10) + F.least(10 * F.ln(1 + g2 + 0.1 * g3), F.lit(40.0))
    s = s * (1 - total / F.when(doc_len > 0, doc_len).otherwise(F.lit(1)))
    return (F.least(F.lit(80.0), F.greatest(F.lit(1.0), s)) + citation_rank).cast("int")


def reduced_html_score(title: Column, meta: Column, heading: Column, total: Column) -> Column:
    """Counts only: no positions, density or ranks; not truncated."""
    s = F.least(7.5 * title, F.lit(15.0)) + F.least(3 * heading, F.lit(9)) + F.least(2 * meta, F.lit(6))
    s = s + F.least(7 * F.ln(1 + F.greatest(F.lit(0), total - (title + heading + meta))), F.lit(20.0))
    return F.least(F.lit(80.0), F.greatest(F.lit(1.0), s))


def close_matches(positions: Column, gap: int = 2) -> Column:
    """How many neighbours among sorted positions are at most ``gap`` apart."""
    p = F.sort_array(positions)
    steps = F.transform(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x, i: x - F.get(p, i))
    return F.size(F.filter(steps, lambda d: d <= gap))


def cluster_range(positions: Column) -> Column:
    return F.coalesce(F.array_max(positions) - F.array_min(positions), F.lit(0))


def closest_cluster(lists: Column) -> Column:
    """struct(begin, width) of the narrowest range that holds a position of each list; of equal ones the first. Null if a list is empty."""
    starts = F.array_sort(F.array_distinct(F.flatten(lists)))
    reach = lambda v: F.transform(lists, lambda own: F.array_min(F.filter(own, lambda y: y >= v)))
    spans = F.transform(starts, lambda v: F.struct((F.array_max(reach(v)) - v).alias("width"), v.alias("begin"), F.exists(reach(v), lambda y: y.isNull()).alias("open")))
    best = F.array_min(F.filter(spans, lambda s: ~s["open"]))
    return F.when(best.isNotNull(), F.struct(best["begin"].alias("begin"), best["width"].alias("width")))
