"""Line dedup by pairwise alignment.

Documents that share line hashes are paired; each pair is aligned by patience diff (lines unique to both
sides, longest increasing run of them, then the gaps between, extended over equal lines; in a gap without such lines
the longest common run of lines, then those on either side of it), and every aligned
common block of ``min_words`` words or more is deleted from the later document, the one of the larger id.

Pairs come from shared lines: every holder of a line is paired with the line's first holder, and where the
line is rare (at most ``rare_df`` documents) also with the holder before it. Runs of lines that just reach
``min_words``, from each line on and up to each line, count as lines here, so every line of a common block lies
in a run whose first holder is a partner. So the number of pairs is linear
in the lines however common one of them is, and no line is left out for being common. Only arrays of line
hashes travel to the alignment, not texts.

Lines are compared after white space is trimmed and collapsed. Defined results: null or empty text is one
empty line and keeps it; a row without id is left as it is; rows that share an id are separate texts that
are not paired with each other; an empty table gives an empty result; a document all of whose lines go keeps
the empty text. Deletion is judged on the input, not on what is left. Columns besides id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchloom.llm.common import Scratch, clean_text

LINK_WORDS = 3


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j), increasing in both, of equal lines."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        at_b = {b[k]: k for k in range(j, j_end) if in_b[b[k]] == 1}
        both = [(k, at_b[a[k]]) for k in range(i, i_end) if in_a[a[k]] == 1 and a[k] in at_b]
        if not both:
            # no line to anchor at: the longest common runs, as lines repeat here
            if not in_a.keys().isdisjoint(in_b):
                for p, q, n in SequenceMatcher(None, a[i:i_end], b[j:j_end], autojunk=False).get_matching_blocks():
                    out += [(i + p + k, j + q + k) for k in range(n)]
            continue
        # longest increasing run of the places in b
        tops: list[int] = []
        ends: list[int] = []
        back = [-1] * len(both)
        for k, (_, q) in enumerate(both):
            pile = bisect_left(tops, q)
            back[k] = ends[pile - 1] if pile else -1
            tops[pile : pile + 1] = [q]
            ends[pile : pile + 1] = [k]
        run, k = [], ends[-1]
        while k >= 0:
            run.append(both[k])
            k = back[k]
        i0, j0 = i, j
        for p, q in reversed(run):
            todo.append((i0, p, j0, q))
            out.append((p, q))
            i0, j0 = p + 1, q + 1
        todo.append((i0, i_end, j0, j_end))
    return sorted(out)


def common_blocks(later: list[int], earlier: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines of ``later`` in aligned blocks (consecutive on both sides) of at least ``min_words`` words."""
    removed: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if before != (i - 1, j - 1):
            if sum(words[k] for k in block) >= min_words:
                removed += block
            block = []
        block.append(i)
        before = (i, j)
    return removed


def run_hashes(hashes: np.ndarray, words: list[int], min_words: int) -> list[int]:
    """Hashes of the shortest runs of ``min_words`` words or more from each line on and up to each line; single lines only where they are too short to link."""
    import xxhash

    upto = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(upto, upto[:-1] + min_words, "left")
    starts = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    runs = {(s, e) for s, e in enumerate(ends.tolist()) if e < len(upto)} | {(s, e) for e, s in enumerate(starts.tolist(), 1) if s >= 0}
    raw = hashes.tobytes()
    found = {xxhash.xxh3_64_intdigest(raw[8 * s : 8 * e], e - s) for s, e in runs if e - s > 1 or min_words < LINK_WORDS}
    return np.array(list(found), np.uint64).view(np.int64).tolist()


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            hashes, words, runs = [], [], []
            for t in b.column(2):
                cut = [line.split() for line in (t.as_py() or "").split("\n")]
                hashes.append(np.array([digest(" ".join(w)) for w in cut], np.uint64).view(np.int64))
                words.append([len(w) for w in cut])
                runs.append(run_hashes(hashes[-1], words[-1], min_words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int64()))], ["doc_id", "tk", "hashes", "words", "runs"])

    return docs.mapInArrow(lines, "doc_id long, tk long, hashes array<long>, words array<int>, runs array<long>")


def _align(min_words: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed = []
            for later, words, earlier in zip(b.column("hashes").to_pylist(), b.column("words").to_pylist(), b.column("other").to_pylist()):
                removed.append(common_blocks(later, earlier, words, min_words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), pa.array(removed, pa.list_(pa.int32()))], ["doc_id", "tk", "removed"])

    return align


def removed_lines(df: DataFrame, min_words: int = 10, rare_df: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tk, removed_lines of the texts that lose a line; tk is xxhash64 of the text."""
    scratch = Scratch(df.sparkSession, "line-dedup")
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(clean_text(F.col(text_col))).alias("tk"), clean_text(F.col(text_col)).alias("t"))
    lines = scratch.write(_lines(docs, min_words), "lines")
    # distinct inside a document natively, so a document's repeated line counts once
    link = F.array_distinct(F.transform(F.filter(F.arrays_zip("hashes", "words"), lambda x: x["words"] >= LINK_WORDS), lambda x: x["hashes"]))
    held = lines.select("doc_id", F.explode(F.array_union(link, "runs")).alias("h"))
    first = held.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("df")).where("first <> last").select(F.col("h").alias("k"), "first", "df")
    shared = scratch.write(held.join(first, F.col("h") == F.col("k")).select("h", "doc_id", "first", "df"), "shared")
    stars = shared.where("doc_id <> first").select(F.col("doc_id").alias("later"), F.col("first").alias("earlier"))
    before = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    chains = shared.where(F.col("df") <= rare_df).select(F.col("doc_id").alias("later"), before.alias("earlier")).where("earlier < later")
    pairs = stars.union(chains).distinct()
    found = (
        pairs.join(lines.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("other")), "earlier")
        .join(lines, F.col("later") == F.col("doc_id")).select("doc_id", "tk", "hashes", "words", "other")
        .mapInArrow(_align(min_words), "doc_id long, tk long, removed array<int>")
    )
    return found.where(F.size("removed") > 0).select("doc_id", "tk", F.explode("removed").alias("line")).distinct().groupBy("doc_id", "tk").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))


def line_dedup(df: DataFrame, min_words: int = 10, rare_df: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, removed_lines, kept_text."""
    gone = removed_lines(df, min_words, rare_df, id_col, text_col).select(F.col("doc_id").alias("g_id"), F.col("tk").alias("g_tk"), "removed_lines")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).alias("t"))
    out = rows.join(gone, (F.col("doc_id") == F.col("g_id")) & (F.xxhash64("t") == F.col("g_tk")), "left")
    cut = F.split("t", "\n", -1)
    kept = F.array_join(F.filter(cut, lambda x, i: ~F.array_contains("removed_lines", i.cast("int"))), "\n")
    return out.select(
        "doc_id", F.size(cut).alias("n_lines"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), F.when(F.col("removed_lines").isNull(), F.col("t")).otherwise(kept).alias("kept_text")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines, n_kept_bytes, kept_sha256 of every document."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines", F.octet_length("kept_text").cast("long").alias("n_kept_bytes"), F.sha2("kept_text", 256).alias("kept_sha256"))
