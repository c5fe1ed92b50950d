"""Line dedup against brute force over all pairs, mixing against its targets, licence lookup on variants of known texts."""

import math
import random
import textwrap
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchloom.llm import license_scan, line_dedup, mixing
from searchloom.llm.license_texts import KNOWN

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, tk string, block int, digest string"


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", 1, "z") for i, t, s in data], SCHEMA)


@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
@settings(max_examples=300, deadline=None)
def test_patience_is_an_alignment(a, b):
    got = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
    if a == b:
        assert got == [(k, k) for k in range(len(a))]


def test_patience_known():
    assert line_dedup.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert line_dedup.common_blocks([1, 2, 3, 4], [2, 3, 7], [5, 5, 5, 5], 10) == [1, 2]
    assert line_dedup.common_blocks([1, 2, 3, 4], [2, 7, 3], [5, 5, 5, 5], 10) == []


def test_passage_twice():
    twice, once = [1, 2, 9, 1, 2], [7, 1, 2, 8]
    assert line_dedup.common_blocks(twice, once, [6] * 5, 10) in ([0, 1], [3, 4])
    assert line_dedup.common_blocks([5, 1, 2, 6], [1, 2, 9, 1, 2], [6] * 4, 10) == [1, 2]
    assert line_dedup.common_blocks(twice, [7, 1, 2, 8, 1, 2, 7], [6] * 5, 10) == [0, 1, 3, 4]


def test_line_dedup(spark):
    rnd = random.Random(5)
    line = lambda n: " ".join(rnd.choice("abcdefghijklmnop") * 3 + str(rnd.randrange(9999)) for _ in range(n))
    passage, common = [line(7) for _ in range(3)], line(12)
    data = [(None, "\n".join(passage)), (1, None), (2, ""), (3, "\n".join([line(4), *passage, line(4)]))]
    data += [(k, "\n".join([line(6), common, line(5)])) for k in range(10, 100)]
    data += [(200, "\n".join([line(4), line(3), *passage])), (201, "\n".join(passage)), (202, "  " + "\n ".join(passage)), (203, passage[0]), (203, "another\ntext"), (204, "x " * 20000 + "\n" + common)]
    data += [(k, "\n".join(passage)) for k in range(300, 340)]
    rnd.shuffle(data)
    out = line_dedup.line_dedup(frame(spark, [(i, t, "s") for i, t in data]).repartition(3), rare_df=8).collect()
    assert len(out) == len(data)
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r)
    assert got[None][0].removed_lines == [] and got[1][0].kept_text == "" and got[1][0].n_lines == 1
    assert got[3][0].removed_lines == [] and got[10][0].removed_lines == []
    assert all(got[k][0].removed_lines == [1] for k in range(11, 100))
    assert got[200][0].removed_lines == [2, 3, 4] and got[201][0].removed_lines == [0, 1, 2] == got[202][0].removed_lines
    assert got[201][0].kept_text == "" and got[204][0].removed_lines == [1]
    assert sorted(r.removed_lines for r in got[203]) == [[], []]
    assert all(got[k][0].removed_lines == [0, 1, 2] for k in range(300, 340))
    for r in out:
        texts = [t or "" for i, t in data if i == r.doc_id]
        assert any("\n".join(x for k, x in enumerate(t.split("\n")) if k not in r.removed_lines) == r.kept_text for t in texts)
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []


def test_blocks_of_short_lines(spark):
    line = lambda c, n=6: " ".join(f"{c}{k}" for k in range(n))
    data = [(1, line("a") + "\n" + line("f")), (2, line("b") + "\n" + line("g")), (3, line("a") + "\n" + line("b")), (5, line("h") + "\n" + line("c", 10)), (6, line("k") + "\n" + line("c", 10) + "\n" + line("d", 2))]
    data += [(k, line("a") + f"\nx{k}\n" + line("b")) for k in range(10, 15)]
    data += [(20, line("a") + "\n" + line("b")), (21, line("c", 10) + "\n" + line("d", 2))]
    got = {r.doc_id: r.removed_lines for r in line_dedup.line_dedup(frame(spark, [(i, t, "s") for i, t in data]), rare_df=1).collect()}
    assert got[20] == [0, 1] and got[21] == [0, 1] and got[6] == [1] and not got[3]


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    lines = [" ".join(f"w{k}x{q}" for q in range(rnd.choice([0, 3, 5, 6, 8]))) for k in range(60)]
    blocks = [rnd.sample(lines, rnd.randrange(1, 4)) for _ in range(40)]
    data = []
    for i in range(120):
        own = [[f"own{i} {k} line"] for k in range(3)]
        parts = rnd.sample(blocks, 2) + own
        rnd.shuffle(parts)
        data.append((i, "\n".join(x for p in parts for x in p)))
    want = defaultdict(set)
    cut = [[" ".join(x.split()) for x in t.split("\n")] for _, t in data]
    for i in range(len(data)):
        for j in range(i):
            want[i] |= set(line_dedup.common_blocks(cut[i], cut[j], [len(x.split()) for x in cut[i]], 10))
    got = {r.doc_id: set(r.removed_lines) for r in line_dedup.line_dedup(frame(spark, [(i, t, "s") for i, t in data])).collect()}
    missing = sum(len(want[i] - got[i]) for i in got)
    assert all(got[i] <= want[i] for i in got)
    assert missing == 0, (missing, sum(map(len, want.values())))


def corpus():
    rnd = random.Random(6)
    sizes = {"big": 300, "mid": 60, "small": 12, None: 3}
    return [(k, "w " * rnd.randrange(0, 30) or None, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


@pytest.mark.parametrize("limit", [100.0, 2.5])
def test_mixing(spark, limit):
    data = corpus()
    out = mixing.mix(frame(spark, data), max_repeats=limit, blocks=8).collect()
    tokens, own = defaultdict(int), {}
    for i, t, s in data:
        own[i] = len((t or "").split()) + 1
        tokens[s or ""] += own[i]
    total = sum(tokens.values())
    taken, seen = defaultdict(int), set()
    for r in out:
        assert r.n_tokens == own[r.doc_id] and (r.doc_id, r.epoch) not in seen
        seen.add((r.doc_id, r.epoch))
        taken[r.source] += r.n_tokens
    assert max(taken[s] / tokens[s] for s in tokens) <= limit + 1e-6
    assert total - 31 * len(tokens) <= sum(taken.values()) <= total
    share = lambda d: [v / sum(d.values()) for v in d.values()]
    entropy = lambda d: -sum(p * math.log(p) for p in share(d))
    if limit == 100.0:
        assert abs(entropy(taken) - (entropy(tokens) + math.log(4)) / 2) < 0.05
    else:
        assert entropy(tokens) < entropy(taken) < (entropy(tokens) + math.log(4)) / 2
    for s in tokens:  # whole epochs hold every document; positions have no gap
        for e in {r.epoch for r in out if r.source == s}:
            rows = sorted((r for r in out if r.source == s and r.epoch == e), key=lambda r: r.position)
            at = 0
            for r in rows:
                assert r.position == at
                at += r.n_tokens
    orders = [[r.doc_id for r in sorted((r for r in out if r.source == "small" and r.epoch == e), key=lambda r: r.position)] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(i for i, _, s in data if s == "small")
    rows = mixing.take_mixture(frame(spark, data), max_repeats=limit, blocks=8)
    assert rows.columns == frame(spark, data).columns and Counter(r.doc_id for r in rows.collect()) == Counter(r.doc_id for r in out)
    assert mixing.mix(frame(spark, [])).collect() == []


@pytest.mark.parametrize("blocks", [1, 2, 8, 64])
def test_mixing_repeated_rows_ties_and_clashing_names(spark, blocks):
    """Rows that share id and source go together, null ids and sources count, very long and empty texts fit; names that the operator uses itself do no harm."""
    data = corpus() + [(5, "again " * 9, "big"), (5, "again " * 9, "big"), (None, "x y", "mid"), (None, "z", "mid"), (900, "w " * 200_000, "big"), (901, None, "small"), (902, "", "small")]
    df = frame(spark, data)
    for c in ("mix_u", "mix_times", "place", "u", "whole"):
        df = df.withColumn(c, F.lit(7))
    out = Counter((r.doc_id, r.source) for r in mixing.mix(df, max_repeats=3.0, blocks=blocks).collect())
    rows = mixing.take_mixture(df, max_repeats=3.0, blocks=blocks)
    assert rows.columns == df.columns
    own = Counter((i, s or "") for i, _, s in data)
    assert Counter((r.doc_id, r.source or "") for r in rows.collect()) == Counter({k: n * own[k] for k, n in out.items()})
    assert mixing.take_mixture(df.limit(0)).collect() == []


def test_block_count():
    assert [mixing.block_count(n) for n in (0, 1, 4096**2, 4096**2 + 1, 10**11)] == [4096, 4096, 4096, 8192, 1 << 19]


def test_license_scan(spark):
    mit, bsd = KNOWN[0][1], KNOWN[9][1]
    data = [
        (1, "Copyright (c) 2020 A. Person\n" + mit.upper()), (2, "MIT Licence\n\n(c) 2021 Someone\nAll rights reserved.\n" + mit.replace(",", " ;")), (3, mit + " and more"), (4, None), (5, ""),
        (6, "Copyright 1999 The Company\n\n" + bsd.replace("copyright holder", "copyright owner", 1)), (7, "© 2020\n"), (None, mit), (8, "z" * 100000), (1, mit),
    ]
    out = license_scan.license_scan(frame(spark, [(i, t, "s") for i, t in data])).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r.license_id)
        assert r.is_license == (r.license_id is not None)
    assert dict(got) == {1: ["MIT", "MIT"], 2: ["MIT"], 3: [None], 4: [None], 5: [None], 6: ["BSD-3-Clause"], 7: [None], None: ["MIT"], 8: [None]}
    assert license_scan.license_scan(frame(spark, [])).collect() == []


def test_license_table_of_the_caller(spark):
    own = spark.createDataFrame([("L-1", "Licence licence, sub license organisation"), ("L-2", "other words")], "license_id string, text string")
    data = [(1, "license LICENSE; sublicense organization", "s"), (2, "Copyright 2020 X\nOther, words", "s"), (3, KNOWN[0][1], "s")]
    assert sorted((r.doc_id, r.license_id) for r in license_scan.license_scan(frame(spark, data), own).collect()) == [(1, "L-1"), (2, "L-2"), (3, None)]


def test_known_licenses_in_other_wrappings(spark):
    ways = [lambda t, w=w: textwrap.fill(" ".join(t.split()), w, break_long_words=False) for w in (20, 40, 60, 72, 79, 10**6)]
    data = [(n * 100 + k, "Copyright 2020 A. Person\nCopyright Some Company\n\n" + way(t), "s") for n, (_, t) in enumerate(KNOWN) for k, way in enumerate(ways)]
    assert [(r.doc_id, r.license_id) for r in license_scan.license_scan(frame(spark, data)).collect() if r.license_id != KNOWN[r.doc_id // 100][0]] == []
