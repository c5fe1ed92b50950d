"""Repeated byte strings against brute force over every window; the suffix sort against sorted()."""

import hashlib
import random

import numpy as np
import pytest

from searchloom.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, lang string, tk string, spans string, kind int"


def brute(data, length=100):
    """(n_bytes, n_removed, n_spans, sha256) by id; ids are distinct."""
    seen, out = {}, {}
    rows = sorted((i, (t or "").encode()) for i, t in data)
    for i, raw in rows:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen.setdefault(raw[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = len([1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])])
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_order():
    rng = np.random.default_rng(3)
    buffer = rng.integers(97, 100, 4000).astype(np.uint8)
    buffer[1000:2000] = buffer[:1000]
    at = rng.permutation(3800)
    group = np.sort(rng.integers(0, 40, 3800))
    raw = buffer.tobytes()
    want = sorted(range(3800), key=lambda k: (group[k], raw[at[k] : at[k] + 100], k))
    for bits in (64, 8, 1):  # collisions are found out
        assert sd.SuffixOrder(buffer, 100, bits).sort(at, group).tolist() == want


def test_only_neighbourhoods_met_again_are_sorted(monkeypatch):
    """Runs that share their anchor by chance and no more are not sorted; of the others every repeated window is found."""
    sorted_windows, sort = [], sd.SuffixOrder.sort
    monkeypatch.setattr(sd.SuffixOrder, "sort", lambda self, at, group: sorted_windows.append(len(at)) or sort(self, at, group))
    piece = sd._answer(100, 1, 1)[1]
    rng = np.random.default_rng(6)

    def runs(texts):
        rows = np.zeros(len(texts), piece)
        rows["h"], rows["doc"], rows["a"], rows["p"], rows["text"] = 5, np.arange(len(texts)), 76, 76, [np.void(t) for t in texts]
        return rows  # windows 0..76, with the anchor at byte 76 of the text

    chance = [rng.bytes(76) + b"k" * 24 + rng.bytes(100) for _ in range(300)]
    assert len(sd.repeated_windows(runs(chance), 100)) == 0
    assert sorted_windows == [0]
    copies = [chance[7][:40] + chance[8][40:], chance[9][:50] + b"#" + chance[9][51:], chance[9][:120] + b"#" + chance[9][121:]]
    for bits in (64, 8, 1):  # collisions only add to what is sorted
        out = [tuple(map(int, s)) for s in sd.repeated_windows(runs(chance + copies), 100, bits)]
        assert out == [(300, 0, 40, 176), (301, 0, 51, 176), (302, 0, 0, 120)]
    assert sorted_windows[1] < 77 * 303 / 50


def test_runs_cover_all_windows():
    rnd = random.Random(4)
    docs = [bytes(rnd.choice(b"abcd ") for _ in range(n)) for n in (100, 101, 350, 2000)] + [b"a" * 500, b"ab" * 400]
    sizes = np.array([len(d) for d in docs])
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    doc, s1, s2, at, h = sd.runs_of(np.frombuffer(b"".join(docs), np.uint8), begins, begins + sizes, 100, 24)
    seen = sorted((int(d), int(s) - int(begins[d])) for d, a, b in zip(doc, s1, s2) for s in range(a, b + 1))
    assert seen == [(k, s) for k, d in enumerate(docs) for s in range(len(d) - 99)]
    assert ((at >= s2) & (at <= s1 + 76)).all()


def texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line, long = prose(60), prose(14), prose(400)
    data = [(0, None), (1, ""), (2, "short"), (3, passage), (4, "x" * 99), (5, "x" * 100), (6, "y" * 1000), (7, "ab" * 300 + passage)]
    data += [(10 + k, prose(rnd.randint(0, 40)) + passage + prose(rnd.randint(0, 40))) for k in range(60)]
    data += [(100 + k, prose(20) + line + prose(20)) for k in range(40)]
    data += [(200 + k, long) for k in range(20)]
    for k in range(20):
        own = long.split(" ")
        for _ in range(3):
            own[rnd.randrange(len(own))] = word()
        data.append((300 + k, " ".join(own)))
    data += [(400, long[:500] + long[300:900]), (401, (line + " ") * 5), (402, prose(9000)), (403, passage[3:] + passage[:-5])]
    return data


@pytest.mark.parametrize(("task_classes", "sort_classes", "flush", "bits"), [(4, 500, 1_000_000, 64), (1, 3, 200, 64), (10**6, 10**6, 500, 8), (1000, 500, 100, 8)])
def test_against_every_window(spark, task_classes, sort_classes, flush, bits):
    limits = sd.Limits(task_classes, sort_classes, flush, group_bytes=5000, section_bytes=700, least_buckets=3, hash_bits=bits)
    data = texts()
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in data], SCHEMA).repartition(4)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_dedup(df, limits=limits).collect()}
    assert out == brute(data)


def test_odd_rows(spark):
    t = " ".join(f"w{k}" for k in range(100))
    data = [(None, t), (1, t), (1, t), (2, t)]
    out = sd.substring_dedup(spark.createDataFrame([(i, x, "x", "y", "z", 1) for i, x in data], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in out), key=str) == sorted([(None, 0), (1, 0), (1, 0), (2, len(t))], key=str)
    assert [(r["begin"], r["end"]) for o in out if o.doc_id == 2 for r in o.removed] == [(0, len(t))]
    assert sd.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op2_suffix_array_dedup(spark, sf_dir).collect()}
    assert out == brute([(r.doc_id, r.text) for r in rows])
