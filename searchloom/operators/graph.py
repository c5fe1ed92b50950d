"""Link analysis: node numbers, PageRank, decile scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.tables import dense_ids, settle


def encode(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(key, id), edges(src, dst)): keys replaced by dense numbers. Which number a key gets has no meaning."""
    keys = edges.select(F.col(src).alias("key")).union(edges.select(F.col(dst).alias("key"))).distinct()
    nodes = dense_ids(keys, [F.col("key")], "id")
    a, b = nodes.select(F.col("key").alias("ka"), F.col("id").alias("src")), nodes.select(F.col("key").alias("kb"), F.col("id").alias("dst"))
    return nodes, edges.join(a, F.col(src) == F.col("ka")).join(b, F.col(dst) == F.col("kb")).select("src", "dst")


def decode(ranks: DataFrame, nodes: DataFrame) -> DataFrame:
    return ranks.join(nodes, ranks["node"] == nodes["id"]).select("key", "rank")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, d: float = 0.85, eps: float = 1e-8, max_iter: int = 200, fixed_iter: int | None = None, reverse: bool = False) -> DataFrame:
    """node, rank of ``edges(src, dst)``; ``nodes(node)`` adds isolated ones.

    Repeated edges weigh by their number. The rank of nodes without out-links is spread evenly. Iterates until the
    L1 change is at most ``eps``, or ``fixed_iter`` times. ``reverse`` turns the edges around.
    Each round is one join and one aggregation, both keyed by node; two sums come back to the driver.
    """
    if reverse:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    weighted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    out_degree = weighted.groupBy("src").agg(F.sum("w").alias("degree"))
    links = settle(weighted.join(out_degree, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("share")))
    ends = links.select(F.col("src").alias("node")).union(links.select(F.col("dst").alias("node")))
    every = ends.distinct() if nodes is None else ends.union(nodes.select("node")).distinct()
    every = every.join(out_degree.select(F.col("src").alias("node"), "degree"), "node", "left").select("node", F.col("degree").isNull().alias("dangling"))
    every = settle(every)
    n = every.count()
    if n == 0:
        return every.select("node", F.lit(0.0).alias("rank"))
    ranks = every.withColumn("rank", F.lit(1.0 / n))
    lost = every.where("dangling").count() / n
    for _ in range(max_iter if fixed_iter is None else fixed_iter):
        moved = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit((1 - d) / n) + F.lit(d) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))
        ranks = settle(ranks.join(moved, F.col("node") == F.col("dst"), "left").select("node", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        total = ranks.agg(F.sum("change").alias("change"), F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost")).first()
        lost = total["lost"]
        if fixed_iter is None and total["change"] <= eps:
            break
    return ranks.select("node", "rank")


def ranked(ranks: DataFrame) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "node")


def decile(place: Column, n: Column) -> Column:
    """Score 10..1 of the row at 0-based ``place`` of ``n`` in descending order: slices of a tenth of n - 1, bounds cut
    to whole numbers, a bound row belonging to the later slice."""
    reached = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: F.floor(i * F.lit(0.1) * (n - 1)) <= place)
    return (10 - F.array_max(reached)).cast("int")


def decile_scores(ranks: DataFrame, key: str = "key") -> DataFrame:
    """``ranks`` with column score. The order is numbered by range partitions, not in one task."""
    n = ranks.count()
    placed = dense_ids(ranks, [F.col("rank").desc(), F.col(key)], "place")
    return placed.withColumn("score", decile(F.col("place"), F.lit(n))).drop("place")
