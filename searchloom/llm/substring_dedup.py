"""Removal of repeated byte strings by a suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a document of a smaller
id, or in the same one). Strings of that length are windows; each window has an anchor, its k-gram of least
hash, which depends on the window's bytes alone, so equal windows have equal anchors at equal places. The
windows of one anchor occurrence are consecutive: a run. That splits the sort of all suffixes into one
small sort for each anchor value:

1. Scan. Runs of equal anchor and equal bytes (a class, told apart by a 128-bit BLAKE2 digest of the bytes)
   are combined in the task: all but the earliest go. What remains is dealt by anchor hash, packed as arrays.
2. By anchor hash. An anchor met once settles its run. Classes are combined again. If an anchor still has
   several classes, their bytes are asked for - only those runs.
3. Suffix sort. Windows of the classes of an anchor are sorted by mergesort, their bytes compared eight at a time.
   Windows whose three quarters about the anchor are met in no other class have no equal and are not sorted; that is
   told by polynomial hashes, whose collisions only add to what is sorted.
4. The spans found are joined to the texts.

So polynomial hashes only deal and speed up; strings count as equal by their bytes, or by equal 128-bit BLAKE2
digests of their bytes where the bytes themselves do not travel.

Skew. A common passage is one row per task in step 2. Anchors at the edge of a passage that very many
documents share have a class for each document; where a task or an anchor has more than a few, their
windows are dealt one by one, by the digest of the window, combined in each task first. Very long texts
are hashed in sections.

Defined results: null text is empty; a row without id is left whole and takes no part; rows that share an
id and the text are one document; texts that share an id are one document in the order of byte positions,
and each loses its own spans. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm.common import Scratch, clean_text
from searchloom.llm.hashing import mix, powers, prefix_hashes

LENGTH, GRAM = 100, 24


@dataclass(frozen=True)
class Limits:
    """Sizes of work units; none changes the result."""

    task_classes: int = 4  #: classes of one anchor that a task deals by anchor; beyond, windows are dealt one by one
    sort_classes: int = 500  #: classes of one anchor that one suffix sort takes
    flush_runs: int = 250_000  #: runs that a scan task combines at a time
    group_bytes: int = 1 << 19  #: text hashed at a time
    section_bytes: int = 1 << 21  #: windows of a long text hashed at a time
    bucket_bytes: int = 4 << 20  #: estimated input bytes for each bucket
    least_buckets: int = 64
    hash_bits: int = 64  #: of the polynomial hashes that deal and that choose what is sorted; fewer mean more collisions


RUN = np.dtype([("h", "<u8"), ("c", "<u8"), ("c2", "<u8"), ("doc", "<i8"), ("p", "<i4"), ("tk", "<i4"), ("a", "u1"), ("b", "u1"), ("hot", "u1")])
CLASS = ("h", "c", "c2", "a", "b")
WINDOW = np.dtype([("w", "<u8"), ("v", "<u8"), ("doc", "<i8"), ("s", "<i4"), ("tk", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("tk", "<i4"), ("s", "<i4"), ("e", "<i4")])
RUNS, WINDOWS, SPANS, ASK_BYTES, ASK_WINDOWS = range(5)
PACKED = "kind int, bucket int, data binary"


def packed(kind: int, rows: np.ndarray, buckets: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of a structured array, field after field (so that they compress), one binary for each bucket."""
    if buckets is None:
        buckets = np.zeros(len(rows), np.int64)
    order = np.argsort(buckets, kind="stable")
    rows, buckets = rows[order], buckets[order]
    cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(rows) else np.zeros(0, np.int64)
    data = [b"".join(rows[n][i:j].tobytes() for n in rows.dtype.names) for i, j in zip(cuts, [*cuts[1:], len(rows)])]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(cuts), pa.int32()), pa.array(buckets[cuts].astype(np.int32)), pa.array(data, pa.binary())], ["kind", "bucket", "data"])


def unpacked(data: list[bytes], dtype: np.dtype) -> np.ndarray:
    parts = []
    for d in data:
        n, at = len(d) // dtype.itemsize, 0
        out = np.empty(n, dtype)
        for name in dtype.names:
            kind = dtype[name]
            out[name] = np.frombuffer(d, kind, n, at)
            at += n * kind.itemsize
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i+width] for each i, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _leftmost(grams: np.ndarray, least: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The first place of the least k-gram of the windows at ``starts``."""
    at = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 20_000):
        part = starts[i : i + 20_000]
        at[i : i + 20_000] = part + (grams[part[:, None] + np.arange(width)] == least[part][:, None]).argmax(1)
    return at


def runs_of(buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, hash of anchor) of all runs.

    ``buffer`` holds documents of at least ``length`` bytes, at begins:ends.
    """
    width = length - gram + 1
    big = prefix_hashes(buffer)
    _, down = powers(len(buffer))
    grams = mix((big[gram:] - big[:-gram]) * down[: len(buffer) - gram + 1])
    least = sliding_min(grams, width)
    first = np.zeros(len(least), bool)
    first[begins] = True
    last_window = np.zeros(len(buffer) + 1, np.int32)
    np.add.at(last_window, begins, 1)
    np.add.at(last_window, ends - length + 1, -1)
    valid = np.cumsum(last_window)[: len(least)] > 0
    begin = first | np.r_[True, least[1:] != least[:-1]]
    s1 = np.flatnonzero(begin & valid)
    edge = np.flatnonzero(begin | ~valid)
    nxt = np.searchsorted(edge, s1, "right")
    s2 = np.where(nxt < len(edge), edge[np.minimum(nxt, len(edge) - 1)], len(least)) - 1
    # the leftmost least k-gram
    at = _leftmost(grams, least, s1, width)
    ties = np.flatnonzero(s2 > at)  # runs that outlive their first anchor, as in periodic text: window by window
    if len(ties):
        n = s2[ties] - at[ties]
        rest = np.repeat(at[ties] + 1 - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        own = _leftmost(grams, least, rest, width)
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (rest[1:] != rest[:-1] + 1)])
        s2[ties] = at[ties]
        s1, s2, at = np.r_[s1, rest[new]], np.r_[s2, rest[np.r_[new[1:], len(rest)] - 1]], np.r_[at, own[new]]
    doc = np.searchsorted(begins, s1, "right") - 1
    return doc, s1, s2, at, grams[at]


def digests(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests, as pairs of 64-bit numbers, of some strings of a text."""
    own = hashlib.blake2b
    raw = b"".join([own(text[i:j], digest_size=16).digest() for i, j in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def combine(rows: np.ndarray, keys: tuple[str, ...], order: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by keys and order, which are the first of their keys, and which come later than that (not the first met again)."""
    at = np.lexsort([rows[n] for n in (*order[::-1], *keys[::-1])])
    rows = rows[at]
    first = np.ones(len(rows), bool)
    first[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
    head = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    later = np.zeros(len(rows), bool)
    for n in order:
        later |= rows[n] != rows[n][head]
    return rows, first, later


def spans(doc: np.ndarray, tk: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Spans, those of a document united where they touch."""
    out = np.zeros(len(doc), SPAN)
    out["doc"], out["tk"], out["s"], out["e"] = doc, tk, s, e
    if not len(out):
        return out
    out = out[np.lexsort((out["s"], out["tk"], out["doc"]))]
    same = (out["doc"][1:] == out["doc"][:-1]) & (out["tk"][1:] == out["tk"][:-1])
    group = np.r_[0, np.cumsum(~same)].astype(np.int64)
    reach = np.maximum.accumulate(out["e"] + (group << 32)) - (group << 32)
    new = np.r_[True, ~same | (out["s"][1:] > reach[:-1])]
    begin = np.flatnonzero(new)
    merged = out[begin]
    merged["e"] = reach[np.r_[begin[1:], len(out)] - 1]
    return merged


def _scan(length: int, gram: int, buckets: int, limits: Limits):
    def flush(rows: np.ndarray, texts: dict[tuple[int, int], bytes]) -> Iterator[pa.RecordBatch]:
        by_h, first, later = combine(rows, CLASS, ("doc", "p"))
        rest = by_h[later]
        yield packed(SPANS, spans(rest["doc"], rest["tk"], rest["p"] - rest["a"], rest["p"] - rest["b"] + length))
        own = by_h[first]
        new = np.r_[True, own["h"][1:] != own["h"][:-1]]
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > limits.task_classes)[group]
        crowd = own[many]
        if len(crowd):
            out = []
            by_doc = crowd[np.lexsort((crowd["tk"], crowd["doc"]))]
            cut = np.flatnonzero(np.r_[True, (by_doc["doc"][1:] != by_doc["doc"][:-1]) | (by_doc["tk"][1:] != by_doc["tk"][:-1])])
            for i, j in zip(cut, [*cut[1:], len(by_doc)]):
                part = by_doc[i:j]
                out.append(windows_of(texts[int(part["doc"][0]), int(part["tk"][0])], part, length))
            yield from window_batches(np.concatenate(out), buckets, length)
            flag = own[many & new].copy()
            flag["hot"], flag["c"], flag["c2"] = 1, 0, 0
            own = np.concatenate([own[~many], flag])
        yield packed(RUNS, own, (own["h"] % np.uint64(buckets)).astype(np.int64))

    def pieces_of(ids: list, tks: list, column: pa.Array, texts: dict) -> Iterator[tuple[int, int, int, bytes]]:
        """Texts, long ones as sections that share no window."""
        for i, tk, t in zip(ids, tks, column):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            if len(raw) >= length:
                for at in range(0, len(raw) - length + 1, limits.section_bytes):
                    texts[i, tk] = raw
                    yield i, tk, at, raw[at : at + limits.section_bytes + length - 1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        texts: dict[tuple[int, int], bytes] = {}
        n = 0
        for b in batches:
            group: list[tuple[int, int, int, bytes]] = []  # (document, tie key, place in the text, bytes)
            size = 0
            ids, tks = b.column(0).to_pylist(), b.column(1).to_pylist()
            todo: Iterator[tuple[int, int, int, bytes]] = pieces_of(ids, tks, b.column(2), texts)
            for piece in chain(todo, [None]):
                if piece:
                    group.append(piece)
                    size += len(piece[3])
                if group and (size >= limits.group_bytes or piece is None):
                    sizes = np.array([len(g[3]) for g in group])
                    begins = np.r_[0, np.cumsum(sizes)[:-1]]
                    buffer = b"".join([g[3] for g in group])
                    doc, s1, s2, at, h = runs_of(np.frombuffer(buffer, np.uint8), begins, begins + sizes, length, gram)
                    rows = np.zeros(len(doc), RUN)
                    rows["h"], rows["a"], rows["b"] = h >> np.uint64(64 - limits.hash_bits), at - s1, at - s2
                    c = digests(buffer, s1, s2 + length)
                    rows["c"], rows["c2"] = c[:, 0], c[:, 1]
                    of = [np.array([g[k] for g in group])[doc] for k in range(3)]
                    rows["doc"], rows["tk"], rows["p"] = of[0], of[1], at - begins[doc] + of[2]
                    kept.append(rows)
                    n += len(rows)
                    group, size = [], 0
                    if n >= limits.flush_runs:
                        yield from flush(np.concatenate(kept), texts)
                        kept, n = [], 0
                        texts.clear()
        if n:
            yield from flush(np.concatenate(kept), texts)

    return scan


def windows_of(text: bytes, runs: np.ndarray, length: int) -> np.ndarray:
    """The windows of some runs of one document."""
    lo, hi = runs["p"].astype(np.int64) - runs["a"], runs["p"].astype(np.int64) - runs["b"]
    n = hi - lo + 1
    starts = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    out = np.zeros(len(starts), WINDOW)
    c = digests(text, starts, starts + length)
    out["w"], out["v"] = c[:, 0], c[:, 1]
    out["doc"], out["tk"], out["s"] = runs["doc"][0], runs["tk"][0], starts
    return out


def window_batches(rows: np.ndarray, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Windows combined: the earliest of equal ones are dealt on, the spans of the others are given out."""
    rows, first, later = combine(rows, ("w", "v"), ("doc", "s"))
    rest = rows[later]
    yield packed(SPANS, spans(rest["doc"], rest["tk"], rest["s"], rest["s"] + length))
    rows = rows[first]
    yield packed(WINDOWS, rows, (rows["w"] % np.uint64(buckets)).astype(np.int64))


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
    return pa.Table.from_batches(batches, schema)


def _by_anchor(length: int, buckets: int, limits: Limits):
    def settle(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        data = t.column("data").to_pylist()
        out = [packed(SPANS, unpacked([data[k] for k in np.flatnonzero(kind == SPANS)], SPAN))]
        through = np.flatnonzero(kind == WINDOWS)
        if len(through):
            out += window_batches(unpacked([data[k] for k in through], WINDOW), buckets, length)
        rows, first, later = combine(unpacked([data[k] for k in np.flatnonzero(kind == RUNS)], RUN), CLASS, ("doc", "p"))
        rest = rows[later & (rows["hot"] == 0)]
        out.append(packed(SPANS, spans(rest["doc"], rest["tk"], rest["p"] - rest["a"], rest["p"] - rest["b"] + length)))
        rows = rows[first]
        if len(rows):
            group = np.cumsum(np.r_[True, rows["h"][1:] != rows["h"][:-1]]) - 1
            classes, hot = np.bincount(group)[group], np.bincount(group, rows["hot"])[group] > 0
            real = rows["hot"] == 0
            for kind_out, which in ((ASK_WINDOWS, real & (hot | (classes > limits.sort_classes))), (ASK_BYTES, real & ~hot & (classes > 1) & (classes <= limits.sort_classes))):
                out.append(packed(kind_out, rows[which]))
        return _table(out)

    return settle


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests, one row for each document of a chunk."""
    for b in batches:
        for kind, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            rows = unpacked([data], RUN)
            rows = rows[np.lexsort((rows["tk"], rows["doc"]))]
            cut = np.flatnonzero(np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tk"][1:] != rows["tk"][:-1])])
            ends = [*cut[1:], len(rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc"][cut]), pa.array(rows["tk"][cut]), pa.array([bytes([kind]) + rows[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], ["g_doc", "g_tk", "ask"]
            )


def _answer(length: int, buckets: int, sorts: int):
    """Bytes of the runs asked for, and windows of those that are dealt one by one."""
    piece = np.dtype([("h", "<u8"), ("doc", "<i8"), ("p", "<i4"), ("tk", "<i4"), ("a", "u1"), ("b", "u1"), ("text", f"V{2 * length}")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, windows = [], []
            for text, asks in zip(b.column("t"), b.column("asks").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for ask in asks:
                    rows = np.frombuffer(ask, RUN, -1, 1)
                    if ask[0] == ASK_WINDOWS:
                        windows.append(windows_of(raw, rows, length))
                        continue
                    own = np.zeros(len(rows), piece)
                    for n in ("h", "doc", "p", "tk", "a", "b"):
                        own[n] = rows[n]
                    padded = raw + bytes(2 * length)
                    for k, s in enumerate((rows["p"].astype(np.int64) - rows["a"]).tolist()):
                        own["text"][k] = np.void(padded[s : s + 2 * length])
                    pieces.append(own)
            if pieces:
                rows = np.concatenate(pieces)
                yield packed(ASK_BYTES, rows, (rows["h"] % np.uint64(sorts)).astype(np.int64))
            if windows:
                yield from window_batches(np.concatenate(windows), buckets, length)

    return answer, piece


class SuffixOrder:
    """Suffixes of a buffer, compared over at most ``length`` bytes, eight at a time; prefix hashes of parts of it."""

    def __init__(self, buffer: np.ndarray, length: int, bits: int = 64):
        self.length, self.drop = length, np.uint64(64 - bits)
        self.big = prefix_hashes(buffer)
        self.down = powers(len(buffer))[1]
        # the eight bytes from each place on, as a number: numbers are ordered as the bytes are
        padded = np.concatenate([buffer, np.zeros(7, np.uint8)])
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8")[:, 0].astype(np.uint64)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes begin:end."""
        return (self.big[end] - self.big[begin]) * self.down[begin] >> self.drop

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x < y, x == y) over ``length`` bytes."""
        less, equal = np.zeros(len(x), bool), np.zeros(len(x), bool)
        open_ = np.arange(len(x))  # equal so far
        for k in range(0, self.length, 8):
            rest = np.uint64(8 * max(0, k + 8 - self.length))  # bits past the last byte
            u, v = self.words[x[open_] + k] >> rest, self.words[y[open_] + k] >> rest
            less[open_] = u < v
            open_ = open_[u == v]
            if not len(open_):
                break
        equal[open_] = True
        return less, equal

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """An order of the suffixes ``at`` that sorts each group (equal, adjacent values) and is stable: bottom-up mergesort, all groups at once."""
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[begin, len(group)])
        base, room = np.repeat(begin, size), np.repeat(size, size)
        order = np.arange(len(at))
        width = 1
        while width < size.max(initial=0):
            k = np.flatnonzero(room > width)  # places, in groups that have more than one run
            inside = k - base[k]
            run = inside // width
            right = run % 2 == 1
            other = np.where(right, (run - 1) * width, (run + 1) * width)
            n_other = np.clip(room[k] - other, 0, width)
            low, high = np.zeros(len(k), np.int64), n_other.copy()
            x = at[order[k]]
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) >> 1
                y = at[order[base[k[live]] + other[live] + mid]]
                y_less, equal = self.less(y, x[live])
                before = y_less | (equal & right[live])  # of equal ones the left run's come first
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
            place = base[k] + np.where(right, run - 1, run) * width + inside % width + low
            merged = order.copy()
            merged[place] = order[k]
            order = merged
            width *= 2
        return order


def repeated_windows(rows: np.ndarray, length: int, bits: int = 64) -> np.ndarray:
    """Spans of the windows of ``rows`` (runs with their bytes) that also start earlier among them."""
    rows = rows[np.lexsort((rows["p"], rows["doc"], rows["h"]))]
    buffer = np.frombuffer(rows["text"].tobytes(), np.uint8)
    n = rows["a"].astype(np.int64) - rows["b"] + 1
    row = np.repeat(np.arange(len(rows)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = rows["a"].astype(np.int64)[row] - off  # of the anchor in the window: equal windows have it equal
    at = row * (2 * length) + off
    # Windows of neighbouring places of the anchor share all bytes but a quarter. Equal windows have equal such cores: where
    # a core isn't met again nothing is sorted. Hashes that collide only add to what is sorted.
    order = SuffixOrder(buffer, length, bits)
    step = max(1, length // 4)
    core = at + place % step
    key = mix(order.hashes(core, core + (length - step + 1)) + mix(rows["h"][row] + place.astype(np.uint64)))
    by = np.argsort(key, kind="stable")  # in the order of (document, start) where equal
    group = np.cumsum(np.r_[False, key[by][1:] != key[by][:-1]])
    again = np.bincount(group)[group] > 1
    by, group = by[again], group[again]
    row, off, at = row[by], off[by], at[by]
    sort = order.sort(at, group)
    x, y = at[sort[:-1]], at[sort[1:]]
    equal = np.flatnonzero((group[sort[:-1]] == group[sort[1:]]) & order.less(x, y)[1])
    later = sort[1:][equal]
    r = rows[row[later]]
    s = r["p"] - r["a"] + off[later]
    return spans(r["doc"], r["tk"], s, s + length)


def _suffix_sort(length: int, piece: np.dtype, bits: int):
    def sort(t: pa.Table) -> pa.Table:
        return _table([packed(SPANS, repeated_windows(unpacked(t.column("data").to_pylist(), piece), length, bits))])

    return sort


def _by_window(length: int):
    def settle(t: pa.Table) -> pa.Table:
        rows, _, later = combine(unpacked(t.column("data").to_pylist(), WINDOW), ("w", "v"), ("doc", "s"))
        rest = rows[later]
        return _table([packed(SPANS, spans(rest["doc"], rest["tk"], rest["s"], rest["s"] + length))])

    return settle


def _open_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, one row for each document of a chunk."""
    for b in batches:
        for data in b.column(2).to_pylist():
            rows = unpacked([data], SPAN)
            if not len(rows):
                continue
            rows = rows[np.lexsort((rows["s"], rows["tk"], rows["doc"]))]
            cut = np.flatnonzero(np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tk"][1:] != rows["tk"][:-1])])
            ends = [*cut[1:], len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc"][cut]), pa.array(rows["tk"][cut]), pa.array([np.stack([rows["s"][i:j], rows["e"][i:j]], 1).tobytes() for i, j in zip(cut, ends)], pa.binary())], ["g_doc", "g_tk", "spans"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    for b in batches:
        out: list[tuple] = []
        for i, t, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            raw = t.as_buffer().to_pybytes()
            removed: list[tuple[int, int]] = []
            for s, e in sorted(map(tuple, np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in own]).tolist())) if own else []:
                if removed and s <= removed[-1][1]:
                    removed[-1] = (removed[-1][0], max(e, removed[-1][1]))
                else:
                    removed.append((s, e))
            kept = b"".join(raw[i:j] for i, j in zip([0, *[e for _, e in removed]], [*[s for s, _ in removed], len(raw)]))
            out.append((i, len(raw), len(raw) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), [{"begin": s, "end": e} for s, e in removed]))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def substring_dedup(df: DataFrame, length: int = LENGTH, gram: int = GRAM, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    text = clean_text(F.col(text_col))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 55:  # no estimate
        size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(limits.least_buckets, size // limits.bucket_bytes)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("tk"), text.alias("t"))
    long_docs = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("t") >= length)).select("doc_id", "tk", F.col("t").cast("binary").alias("t"))
    settled = scratch.write(long_docs.mapInArrow(_scan(length, gram, buckets, limits), PACKED).groupBy("bucket").applyInArrow(_by_anchor(length, buckets, limits), PACKED), "settled")

    asks = settled.where(F.col("kind").isin(ASK_BYTES, ASK_WINDOWS)).mapInArrow(_asked, "g_doc long, g_tk int, ask binary").groupBy("g_doc", "g_tk").agg(F.collect_list("ask").alias("asks"))
    answer, piece = _answer(length, buckets, 4 * buckets)  # a sort's bucket is a quarter of a scan's: it takes more memory a byte
    asked = long_docs.join(asks, (F.col("doc_id") == F.col("g_doc")) & (F.col("tk") == F.col("g_tk"))).select("t", "asks")
    answers = scratch.write(asked.mapInArrow(answer, PACKED), "answers")
    sorted_spans = answers.where(F.col("kind") == ASK_BYTES).groupBy("bucket").applyInArrow(_suffix_sort(length, piece, limits.hash_bits), PACKED)
    windows = settled.where(F.col("kind") == WINDOWS).union(answers.where(F.col("kind") == WINDOWS)).groupBy("bucket").applyInArrow(_by_window(length), PACKED)
    found = settled.where(F.col("kind") == SPANS).union(answers.where(F.col("kind") == SPANS)).union(sorted_spans).union(windows)
    per_doc = found.mapInArrow(_open_spans, "g_doc long, g_tk int, spans binary").groupBy("g_doc", "g_tk").agg(F.collect_list("spans").alias("spans"))
    rows = docs.select("doc_id", "tk", F.col("t").cast("binary").alias("t"))
    out = rows.join(per_doc, (F.col("doc_id") == F.col("g_doc")) & (F.col("tk") == F.col("g_tk")), "left").select("doc_id", "t", "spans")
    return out.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin:int,end:int>>")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
