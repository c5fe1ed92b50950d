"""Near duplicates of vectors by buckets of sign prefixes.

A pass signs all vectors by fresh random projections and compares every two that share the first ``bits`` signs,
a bucket; pairs of cosine >= ``threshold`` in double precision are links. Several passes are united. A pair at the
threshold shares a sign with the probability 1 - angle / pi whatever the other vectors are, so the number of
passes that ``recall`` asks for follows from ``bits`` alone and holds in dense topics as elsewhere.

Scale and skew. Equal directions are one row with a weight. ``bits`` leaves about ``window`` rows in a bucket where
vectors are spread evenly. A vector whose buckets all hold at most ``BLOCK`` rows has then met its partners.
The others, of dense topics, go on to more bits and the more passes these need, for as long as that shrinks the
work; at the end large buckets are compared whole, in blocks dealt to many tasks. A bucket gives a star of
its linked rows, not its pairs. Links are then counted over whole components: every two members are compared in
double precision, block by block; that work is quadratic in a component's distinct directions.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
Vectors of different lengths link with nothing. Repeated rows are separate vectors. A row without id links
with nothing, has a null component and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm.common import Scratch, connected_components

MAX_BITS = 60
MORE_BITS = 4
MAX_PASSES = 128
BUCKET = ["dim", "pass", "prefix"]
ROWS_PER_TASK = 20_000
BLOCK = 1024


def passes_for(bits: int, threshold: float, recall: float, least: int = 8) -> int:
    """Passes after which a pair at the threshold has shared ``bits`` signs with probability ``recall``."""
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(least, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _unit(v: list | None) -> np.ndarray | None:
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    top = np.abs(a).max()
    if not np.isfinite(top) or top == 0:
        return None
    a = a / top
    return a / np.sqrt(a @ a) + 0.0  # no negative zeros


def _directions(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [_unit(v.as_py()) for v in b.column(1)]
            raw = [None if u is None else u.tobytes() for u in units]
            digest = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "unit"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(directions, "vec_id long, digest binary, unit binary")


def _keyed(reps: DataFrame, bits: int, passes: int) -> DataFrame:
    """Each vector with its sign prefix of every pass."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        place = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            ids, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            size = np.array([len(r) // 8 for r in raw])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = np.frombuffer(b"".join([raw[k] for k in at]), np.float64).reshape(len(at), d)
                if d not in made:
                    made[d] = np.concatenate([np.random.default_rng([int(d), p, 77]).standard_normal((bits, d)) for p in range(passes)]).T
                prefix = ((x @ made[d] > 0).reshape(len(at), passes, bits) * place).sum(axis=2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), d, np.int32)), pa.array(ids[at]), pa.array([raw[k] for k in at], pa.binary()), pa.array(list(prefix), pa.list_(pa.int64()))],
                    ["dim", "id", "unit", "prefix"],
                )

    return reps.select("id", "unit").mapInArrow(keyed, "dim int, id long, unit binary, prefix array<long>")


def _tasks(rows: DataFrame, keys: list[str], size: Column, extra: list[str]) -> DataFrame:
    """Rows dealt so that every two rows of a group of ``size`` rows meet in one task (``keys``, i, j) of at most about two blocks."""
    blocks = F.ceil(size / BLOCK).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(*keys, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).alias("second"), "id", *extra, "unit")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted rows as tables of whole groups, with the places where groups begin and the end."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if t.num_rows == 0:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for c in keys:
            v = t.column(c).to_numpy()
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        if len(cuts) > 1:
            yield t, cuts
        held = t.slice(cuts[-1])
    if held is not None:
        yield held, [0, held.num_rows]


def _blocks(t: pa.Table, cuts: list[int]) -> Iterator[tuple[slice, int, np.ndarray]]:
    """(rows, number of the first block's rows or -1 where the block is compared with itself, cosines) of each group."""
    raw, second = t.column("unit").to_pylist(), t.column("second").to_numpy()
    same = t.column("i").to_numpy() == t.column("j").to_numpy()
    for s, e in zip(cuts, cuts[1:]):
        m = e - s - int(second[s:e].sum())
        if e - s < 2 or (not same[s] and m in (0, e - s)):
            continue
        x = np.frombuffer(b"".join(raw[s:e]), np.float64).reshape(e - s, -1)
        yield slice(s, e), -1 if same[s] else m, x @ x.T if same[s] else x[:m] @ x[m:].T


def _count(threshold: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _groups(batches, ["component", "i", "j"]):
            ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy().astype(np.float64)
            out_id, out_n = [np.zeros(0, np.int64)], [np.zeros(0)]
            for rows, m, cos in _blocks(t, cuts):
                hit, w = (cos >= threshold).astype(np.float64), weight[rows]
                if m < 0:
                    np.fill_diagonal(hit, 0)
                out_id.append(ids[rows])
                out_n.append(hit @ w if m < 0 else np.concatenate([hit @ w[m:], w[:m] @ hit]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_n).astype(np.int64))], ["id", "n"])

    return count


def _heads(hit: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric matrix of links, the first row it is connected with."""
    head = np.full(len(hit), -1)
    for k in range(len(hit)):
        new = [k] if head[k] < 0 else []
        while len(new):
            head[new] = k
            new = np.flatnonzero(hit[new].any(axis=0) & (head < 0))
    return head


def _stars(threshold: float):
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _groups(batches, BUCKET + ["i", "j"]):
            ids = t.column("id").to_numpy()
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, m, cos in _blocks(t, cuts):
                hit = cos >= threshold
                if m < 0:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                if m >= 0:
                    hit = np.block([[np.zeros((m, m), bool), hit], [hit.T, np.zeros((hit.shape[1],) * 2, bool)]])
                at = np.flatnonzero(hit.any(axis=0))
                own = ids[rows][at]
                first = own[_heads(hit[np.ix_(at, at)])]
                out_a.append(np.minimum(own, first)[own != first])
                out_b.append(np.maximum(own, first)[own != first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return stars


def _links(reps: DataFrame, n: int, window: int, threshold: float, recall: float, scratch: Scratch) -> DataFrame:
    """Stars (a, b) that join what linked pairs join."""

    def level(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, float]:
        keyed = scratch.write(_keyed(rows, bits, passes_for(bits, threshold, recall)), "keyed")
        sizes = keyed.select("dim", F.posexplode("prefix").alias("pass", "prefix")).groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("size"))
        large = scratch.write(sizes.where(F.col("size") > BLOCK), "large")
        return keyed, large, large.agg(F.sum(F.col("size").cast("double") ** 2)).first()[0] or 0.0

    def compared(keyed: DataFrame, large: DataFrame, whole: bool) -> DataFrame:
        rows = keyed.select("dim", "id", "unit", F.posexplode("prefix").alias("pass", "prefix"))
        rows = rows.join(large, BUCKET, "left") if work else rows.withColumn("size", F.lit(None).cast("long"))
        rows = rows.withColumn("size", F.coalesce("size", F.lit(1))) if whole else rows.where("size is null").withColumn("size", F.lit(1))
        deal = [*BUCKET, "i", "j"]
        parts = max(1, -(-n * passes_for(bits, threshold, recall) // ROWS_PER_TASK))
        met = _tasks(rows, BUCKET, F.col("size"), []).repartition(parts, *deal).sortWithinPartitions(*deal, "second", "id")
        return scratch.write(met.mapInArrow(_stars(threshold), "a long, b long").distinct(), "stars")

    bits = max(1, min(MAX_BITS, int(math.log2(max(2, n / window)))))
    keyed, large, work = level(reps, bits)
    found = []
    while work:
        # rows whose buckets are all small are done with this level's passes
        more = bits + MORE_BITS
        if more > MAX_BITS or passes_for(more, threshold, recall) > MAX_PASSES:
            break
        held = keyed.select("dim", "id", F.posexplode("prefix").alias("pass", "prefix")).join(large, BUCKET, "left_semi").select("id").distinct()
        deeper = level(keyed.select("id", "unit").join(held, "id"), more)
        if deeper[2] > 0.8 * work:
            break
        found.append(compared(keyed, large, False))
        (keyed, large, work), bits = deeper, more
    found.append(compared(keyed, large, True))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def embedding_dedup(
    df: DataFrame, threshold: float = 0.95, window: int = 32, recall: float = 0.995, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    vectors = scratch.write(_directions(df, id_col, vec_col), "vectors")
    linkable = vectors.where("digest is not null and vec_id is not null")
    reps = scratch.write(linkable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit")), "directions")
    n = reps.count()
    links = _links(reps, n, window, threshold, recall, scratch)

    # every two members of a component are compared
    comps = scratch.write(connected_components(spark, links, scratch), "components")
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = comps.join(sizes, "component").join(reps.select(F.col("id").alias("node"), "weight", "unit"), "node").withColumnRenamed("node", "id")
    deal = ["component", "i", "j"]
    met = _tasks(members, ["component"], F.col("members"), ["weight"]).repartition(*deal).sortWithinPartitions(*deal, "second", "id")
    counted = met.mapInArrow(_count(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("beyond"))
    stats = (
        reps.select("id", "weight").join(counted, "id", "left").join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("id", (F.col("weight") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    by_digest = reps.select("digest", "id").join(stats, "id").select(F.col("digest").alias("k"), "n_links", "component_id")
    linked = linkable.select("vec_id", "digest").join(by_digest, F.col("digest") == F.col("k")).select("vec_id", "n_links", "component_id")
    alone = vectors.where("digest is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
