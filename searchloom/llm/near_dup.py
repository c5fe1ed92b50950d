"""Near duplicates by circulant MinHash.

Every shingle is placed in a universe of 2**32 by a first permutation; all signature coordinates come from
one second permutation, circularly shifted: coordinate k of a set is the least pi(sigma(x) + k mod 2**32).
Signatures of ``bands * rows`` coordinates are cut into bands; documents that share a band are candidates,
and a link is confirmed on the full shingle sets: 100 * |intersection| >= percent * |union|.

Scale and skew. Documents with the same set (by a 128-bit digest of the whole set and its size) are one
class; one representative of each goes on, so thousands of copies cost one row. Within a band's bucket only
pairs with the bucket's smallest and largest id are formed - linear in the bucket - and confirmed. Then
connected components are found. Buckets that still hold several components are taken up once more, dealt to tasks of
at most two blocks of members such that every member outside the bucket's largest component meets every other one:
of members whose signatures agree nearly enough with one of another component, the full sets are compared, and a
spanning forest of the links across components is given out (links within a component change nothing and are not
tested). So no link between different texts is lost beyond two chances at the threshold: that no band is shared,
under 1e-6 as the number of bands follows from the threshold, and that signatures agree in fewer coordinates than
expected by 5 standard deviations.

Defined results: null text, or text without words, has an empty set, links with nothing and is its own
component. Rows that share an id are one document. A row without id links with nothing, has a null
component and is kept. ``keep_one`` leaves one of the rows that share a kept id and the text. A text of any length
is cut into words section by section. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import workers
from searchloom.llm.common import Scratch, clean_text, connected_components, unused
from searchloom.llm.hashing import mix, shingle_sets

#: The step's name among what a worker keeps.
STEP = "near_dup"
ROWS = 5
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Members of a bucket in a block.
BLOCK = 512
SHIFT = np.uint32(1)


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands that leave a pair at the threshold without a common one with a chance below ``MISS``."""
    p = min((percent / 100) ** rows, 1 - 1e-9)
    return math.ceil(math.log(MISS) / math.log(1 - p))


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row per set, none of them empty."""
    flat = (mix(np.concatenate(sets), 11) >> np.uint64(32)).astype(np.uint32)  # sigma
    begins = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_pi(flat), begins)
        flat += SHIFT
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys + sig[:, r::rows][:, :bands].astype(np.uint64), 3)
    return mix(keys + np.arange(bands, dtype=np.uint64), 5)


def _features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin(STEP)
        for b in batches:
            for begin, sets in shingle_sets((t.as_py() for t in b.column(1)), width):
                n = np.array([len(s) for s in sets], np.int64)
                d1, d2 = (np.array([mix(s, k).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for k in (21, 22))
                some = np.flatnonzero(n)
                sig = signatures([sets[k] for k in some], bands * rows) if len(some) else np.zeros((0, bands * rows), np.uint32)
                keys = np.zeros((len(sets), bands), np.int64)
                keys[some] = band_keys(sig, bands, rows).view(np.int64)
                short = np.zeros((len(sets), bands * rows), np.uint8)  # a byte of each coordinate: enough to tell far from near
                short[some] = sig & np.uint32(255)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(begin, len(sets)), pa.array(n), pa.array(d1), pa.array(d2), pa.array(list(keys), pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
                )
        workers.give_back()

    return docs.mapInArrow(features, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin(STEP)
        for b in batches:
            for begin, own in shingle_sets((t.as_py() for t in b.column(1)), width):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(own)), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], ["id", "shingles"])
        workers.give_back()

    return docs.mapInArrow(sets, "id long, shingles array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _dealt(members: DataFrame) -> DataFrame:
    """``members(key, id, component, sig)`` of buckets with several components, as tasks (key, i, j): every row outside
    its bucket's largest component meets every row of the bucket. Blocks of those rows come first."""
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    size = per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    size = size.where(F.col("all") > F.col("top.n")).select(F.col("key").alias("k"), F.col("top.component").alias("largest"), blocks(F.col("all") - F.col("top.n")).alias("outer"), blocks(F.col("top.n")).alias("inner"))
    rows = members.join(size, F.col("key") == F.col("k")).withColumn("far", F.col("component") != F.col("largest"))
    own = F.when(F.col("far"), F.pmod(F.xxhash64("id"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("id"), F.col("inner"))).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("far"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1))
    rows = rows.withColumn("own", own).withColumn("met", met)
    return rows.select("key", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "id", "component", "sig")


def _plausible(least: int):
    """Members of a task that agree with one of another component in ``least`` coordinates or more."""

    def plausible(t: pa.Table) -> pa.Table:
        _, label = np.unique(t.column("component").to_numpy(), return_inverse=True)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(label), -1)
        near = np.zeros(len(label), bool)
        for k in np.flatnonzero(label != np.bincount(label).argmax()):
            hit = (label != label[k]) & ((sig == sig[k]).sum(1) >= least)
            near |= hit
            near[k] |= hit.any()
        return t.select(["key", "i", "j", "id", "component"]).filter(pa.array(near))

    return plausible


def _across(percent: int):
    """Links between components that share a bucket, confirmed on the members' full sets: a spanning forest, so
    fewer than there are members. Rows of the largest component are only met from the other side."""

    def across(t: pa.Table) -> pa.Table:
        ids, comp = t.column("id").to_numpy(), t.column("component").to_numpy()
        sets = t.column("shingles").combine_chunks()
        begins = sets.offsets.to_numpy()[:-1] - sets.offsets[0].as_py()
        n = np.diff(sets.offsets.to_numpy())
        words, place = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        _, label = np.unique(comp, return_inverse=True)
        outer = np.flatnonzero(label != np.bincount(label).argmax())
        mark = np.zeros(len(words), np.int64)
        out: list[tuple[int, int]] = []
        for k in outer:
            own = place[begins[k] : begins[k] + n[k]]
            if (label == label[k]).all():
                continue
            mark[own] = 1
            both = np.add.reduceat(mark[place], begins)
            mark[own] = 0
            hits = np.flatnonzero((label != label[k]) & (100 * both >= percent * (n + n[k] - both)))
            for m in hits:
                if label[m] != label[k]:
                    out.append((min(ids[m], ids[k]), max(ids[m], ids[k])))
                    label[label == label[m]] = label[k]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return across


def near_dup(
    df: DataFrame, percent: int = 80, width: int = 5, bands: int | None = None, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    bands = bands or bands_for(percent, rows)
    spark = df.sparkSession
    scratch = Scratch(spark, "near-dup")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = scratch.write(_features(docs, width, bands, rows), "features")

    # one representative for each distinct set
    classes = scratch.write(
        feats.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles")
        .agg(F.min("doc_id").alias("rep")),
        "classes",
    )
    reps = feats.where("n_shingles > 0").select(F.col("doc_id").alias("id"), "n_shingles", "d1", "d2", "bands", "sig").join(
        classes.select("rep", F.col("d1").alias("e1"), F.col("d2").alias("e2")), (F.col("id") == F.col("rep")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    )
    members = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    bucketed = scratch.write(members.join(ends, "key"), "buckets")

    ids = bucketed.select("id").distinct()
    sets = scratch.write(_sets(docs.join(ids, docs["doc_id"] == ids["id"], "left_semi"), width).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles")), "sets")
    sizes = sets.select(F.col("id").alias("i"), F.size("shingles").alias("m"))
    stars = (
        bucketed.select("id", F.explode(F.array("low", "high")).alias("hub")).where("id <> hub")
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    )
    fits = stars.join(sizes.select(F.col("i").alias("a"), F.col("m").alias("ma")), "a").join(sizes.select(F.col("i").alias("b"), F.col("m").alias("mb")), "b")
    fits = fits.where(100 * F.least("ma", "mb") >= percent * F.greatest("ma", "mb")).select("a", "b")
    edges = scratch.write(_confirm(fits, sets, percent), "links")
    found = scratch.write(connected_components(spark, edges, scratch), "components")

    # buckets that still hold several components
    marked = bucketed.select("key", "id", "n_shingles").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    p = percent / 100
    least = max(1, math.ceil(bands * rows * p - 5 * math.sqrt(bands * rows * p * (1 - p))))
    open_keys = marked.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    unsettled = scratch.write(marked.join(open_keys, "key", "left_semi").join(reps.select("id", "sig"), "id").select("key", "id", "component", "sig"), "unsettled")
    task = ["key", "i", "j"]
    near = _dealt(unsettled).groupBy(*task).applyInArrow(_plausible(least), "key long, i int, j int, id long, component long").join(sets, "id")
    extra = scratch.write(near.groupBy(*task).applyInArrow(_across(percent), "a long, b long").distinct(), "links")
    if not extra.isEmpty():
        found = scratch.write(connected_components(spark, edges.union(extra), scratch), "components")

    by_class = classes.join(found, classes["rep"] == found["node"], "left").select(
        F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n_shingles").alias("en"), F.coalesce("component", "rep").alias("component_id")
    )
    rows_out = feats.select("doc_id", "n_shingles", "d1", "d2")
    linked = rows_out.where("n_shingles > 0 and doc_id is not null").join(by_class, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n_shingles") == F.col("en")))
    alone = rows_out.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with all their columns, that are kept: one document of each group, and rows without id."""
    keep_id, digest = unused(df, "keep_id", "digest")
    keep = near_dup(df, id_col=id_col, text_col=text_col, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias(keep_id)).distinct()
    out = df.where(F.col(id_col).isNotNull()).join(keep, F.col(id_col) == F.col(keep_id), "left_semi")
    if not df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        out = out.withColumn(digest, F.sha2(clean_text(F.col(text_col)), 256)).dropDuplicates([id_col, digest]).drop(digest)
    return out.unionByName(df.where(F.col(id_col).isNull()))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
