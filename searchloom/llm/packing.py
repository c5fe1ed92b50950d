"""Hierarchical residual packing of token sequences.

Each document's ids, an end mark after them, are cut into pieces of at most ``capacity`` tokens. Pieces of
full length are sequences by themselves. The rest are dealt by row number over nodes of about ``node_items``
pieces; each node packs best-fit (largest first, tightest bin), emits the bins that are nearly full and
passes all underfull ones on, as items, to a merging node, which repeats. Bins with less room than the
smallest item left anywhere are emitted too: nothing fits them. A level has as many nodes as ``node_items``
asks for, so a node's input is bounded whatever the corpus; levels end with a single node, or when one has
left nearly (``least_gain``) as many bins as it was given, as then most bins fit no other.

Defined results: null text is empty, and an empty document is one piece of one token (the end mark);
repeated rows are packed as often as they occur; a null id is packed like any other; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import tokenizer as tok
from searchloom.llm import workers
from searchloom.llm.common import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tok.encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = memoryview(enc.raw(t.as_py()) + end)
                for k in range(0, len(raw), 4 * capacity):
                    part = raw[k : k + 4 * capacity]
                    out.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        workers.give_back()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item; items are to come in descending length, each goes to the fullest bin that has room."""
    rooms: list[int] = []  # distinct residuals, sorted
    bins: dict[int, list[int]] = {}
    where, n = [], 0
    for size in lengths:
        k = bisect_left(rooms, size)
        if k == len(rooms):
            b, room = n, capacity
            n += 1
        else:
            room = rooms[k]
            own = bins[room]
            b = own.pop()
            if not own:
                del bins[room], rooms[k]
        where.append(b)
        left = room - size
        if left:
            if left not in bins:
                bins[left] = []
                insort(rooms, left)
            bins[left].append(b)
    return where


def _pack_node(t: pa.Table, capacity: int, level: int) -> pa.Table:
    """One node: items are the rows that share ``item``; rows come out with their bin, its fill and their place."""
    t = t.sort_by([("item", "ascending"), ("offset", "ascending")])
    node = t.column("node")[0].as_py()
    col = lambda c: t.column(c).to_numpy()
    item = np.cumsum(np.r_[True, col("item")[1:] != col("item")[:-1]]) - 1
    size = np.bincount(item, weights=col("length")).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    where = np.empty(len(size), np.int64)
    where[order] = best_fit(size[order].tolist(), capacity)
    # items of a bin one after the other
    by_bin = np.argsort(where, kind="stable")
    begins = np.cumsum(size[by_bin]) - size[by_bin]
    new_bin = np.r_[True, where[by_bin][1:] != where[by_bin][:-1]]
    base = np.empty(len(size), np.int64)
    base[by_bin] = begins - np.maximum.accumulate(np.where(new_bin, begins, 0))
    fill = np.bincount(where, weights=size).astype(np.int64)
    new = {"offset": col("offset") + base[item], "fill": fill[where[item]], "item": (level << 56) | (node << 24) | where[item]}
    for c, v in new.items():
        t = t.set_column(t.schema.get_field_index(c), c, pa.array(v)) if c in t.column_names else t.append_column(c, pa.array(v))
    return t


def _packer(capacity: int, level: int, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def one(t: pa.Table) -> pa.Table:
        return _pack_node(t, capacity, level).select(names)

    return one


def pack(
    df: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    node_items: int = 1500, nearly_full: float = 0.995, least_gain: float = 0.02,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(df.sparkSession, "pack")
    pieces = scratch.write(cut_pieces(df, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    small = pieces.where(F.col("length") < capacity)
    items, level, nearly = small.count(), 0, int(nearly_full * capacity)
    nodes = max(1, -(-items // node_items))
    own = [x.split()[0] for x in PIECES.split(", ")]
    full = pieces.where(F.col("length") == capacity).select(*own, F.lit(15 << 58).bitwiseOR(F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    emitted = [full]
    emit = lambda rows: emitted.append(rows.select(*own, F.col("item").alias("sequence_id"), "offset"))
    todo = small.select(*own, F.monotonically_increasing_id().alias("item"), F.lit(0).cast("long").alias("offset")).withColumn("node", F.pmod("item", F.lit(nodes)))
    schema = f"{PIECES}, item long, offset long, node long, fill long"
    names = [x.split()[0] for x in schema.split(", ")]
    while True:
        packed = scratch.write(todo.groupBy("node").applyInArrow(_packer(capacity, level, names), schema), f"level{level}")
        if nodes == 1:
            emit(packed)
            break
        under = (F.col("fill") < nearly) & (F.col("offset") == 0)  # one row a bin
        least = packed.where(under).agg(F.min("fill")).first()[0] or capacity
        carried = (F.col("fill") < nearly) & (F.col("fill") + least <= capacity)
        left = packed.where(carried & (F.col("offset") == 0)).count()
        if left == 0 or (level and left > (1 - least_gain) * items):
            emit(packed)
            break
        emit(packed.where(~carried))
        items, level, nodes = left, level + 1, max(1, -(-left // node_items))
        todo = packed.where(carried).drop("fill").withColumn("node", F.pmod(F.xxhash64("item"), F.lit(nodes)))
    out = emitted[0]
    for e in emitted[1:]:
        out = out.unionByName(e)
    return out


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
