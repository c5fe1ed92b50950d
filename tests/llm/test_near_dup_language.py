"""MinHash near duplicates against brute force; language identification against sums over all cuts, and held-out accuracy."""

import base64
import itertools
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from searchloom.llm import hashing, language_id, near_dup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rep long, sig string"


def frame(spark, data):
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, 7, "x") for i, t, lang in data], SCHEMA)


def shingles(t, width=5):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(data, percent):
    """component_id of every row, by every pair that shares a shingle."""
    sets = defaultdict(list)
    for i, t in data:
        if i is not None and shingles(t):
            sets[i].append(shingles(t))
    sets = {i: frozenset().union(*s) for i, s in sets.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    up = {i: i for i, _ in data if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = set()
    for own in where.values():
        for a, b in itertools.combinations(own, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: top(i) for i in up}


def test_shingle_sets_are_those_of_words():
    texts = [None, "", " \n", "One two", "a b c d e", "A B c  d\te f g", "x " * 50, "é É ß", "a b c d e f"]
    for (begin, got) in hashing.shingle_sets(texts, group_bytes=10):
        for k, s in enumerate(got):
            assert len(s) == len(shingles(texts[begin + k])), texts[begin + k]
    sets = [s for _, g in hashing.shingle_sets(texts) for s in g]
    assert len(np.intersect1d(sets[4], sets[8])) == 1 and len(np.intersect1d(sets[4], sets[5])) == 1


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000, np.uint64)
    other = np.r_[base[:800], rng.integers(0, 1 << 63, 200, np.uint64)]
    sig = near_dup.signatures([base, other], 960)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.06


def near_copies():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    data = [(None, "a b c d e f"), (900, None), (901, ""), (902, "only three words"), (903, "Only THREE words"), (904, "a b c d e f"), (905, "x" * 50000 + " y" * 3000)]
    at = 1000
    for size in (2, 5, 40):  # groups whose members differ in a word or two, chains among them
        text = [word() for _ in range(120)]
        for _ in range(size):
            own = list(text)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = word()
            data.append((at, " ".join(own)))
            at += 1
            if rnd.random() < 0.3:
                text = own
    passage = [word() for _ in range(60)]
    for _ in range(30):  # half of each text is shared
        data.append((at, " ".join(passage + [word() for _ in range(60)])))
        at += 1
    data += [(at + k, "same text for many rows of this table") for k in range(50)] + [(1000, data[7][1]), (904, "a b c d e f")]
    rnd.shuffle(data)
    return data


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dup_small(spark, percent):
    data = near_copies()
    out = near_dup.near_dup(frame(spark, [(i, t, "en") for i, t in data]).repartition(4), percent=percent).collect()
    assert len(out) == len(data)
    want = brute(data, percent)
    for r in out:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id == r.component_id)
    n = defaultdict(set)
    for i, t in data:
        n[i].add(len(shingles(t)))
    assert all(r.n_shingles in n[r.doc_id] for r in out)
    assert near_dup.near_dup(frame(spark, [])).collect() == []
    rows = frame(spark, [(i, t, "en") for i, t in data]).withColumnRenamed("sig", "keep_id").withColumnRenamed("rep", "digest")
    kept = near_dup.keep_one(rows, percent=percent)
    assert kept.columns == rows.columns
    left = {(i, t or "") for i, t in data if i is not None and want[i] == i}
    assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == sorted(left)


def test_bands():
    assert [near_dup.bands_for(p) for p in (80, 85, 100)] == [35, 24, 1]


def test_buckets_in_blocks(spark, monkeypatch):
    """Small blocks: texts that share half of their words and thus buckets, chains among them."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    data = near_copies()
    for percent in (60, 80):
        want = brute(data, percent)
        out = near_dup.near_dup(frame(spark, [(i, t, "en") for i, t in data]), percent=percent).collect()
        assert all(r.component_id == want[r.doc_id] for r in out if r.doc_id is not None)


def test_long_text_in_sections(monkeypatch):
    monkeypatch.setattr(hashing, "SECTION", 50)
    texts = ["w%d " % (k % 700) * 1 for k in range(3)] + [" ".join(f"w{k % 300}" for k in range(2000)), "x" * 5000, "a b" + " " * 400 + "c", None, "A b\tc d e f " * 40]
    got = {}
    for begin, sets in hashing.shingle_sets(texts):
        got |= {begin + k: s for k, s in enumerate(sets)}
    monkeypatch.setattr(hashing, "SECTION", 1 << 20)
    want = [s for _, sets in hashing.shingle_sets(texts) for s in sets]
    assert sorted(got) == list(range(len(texts))) and all((got[k] == w).all() and len(w) == len(shingles(texts[k])) for k, w in enumerate(want))


def test_near_dup_table(spark, sf_dir):
    out = {r.doc_id: r for r in near_dup.op3_minhash_near_dedup(spark, sf_dir).collect()}
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(data, 85)
    assert {i: r.component_id for i, r in out.items()} == want
    kept = near_dup.keep_one(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_forward_sums_all_cuts():
    vocab = language_id.pieces("byte_bpe_multi_50k.tiktoken")
    of = {p: k for k, p in enumerate(vocab.pieces)}
    rng = np.random.default_rng(2)
    p = np.vstack([rng.random((vocab.n, 2)) * 0.01, np.zeros(2)])
    model = language_id.Model(["a", "b"], p, "byte_bpe_multi_50k.tiktoken")
    for word in ("the", "straße", "éte", "zzq"):
        raw = (" " + word).encode()
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(raw) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(raw)]
            parts = [raw[i:j] for i, j in itertools.pairwise(at)]
            if all(x in of for x in parts):
                want += np.prod([p[of[x]] for x in parts], axis=0)
        assert np.allclose(model.word_scores([word])[0], np.log(want))


@pytest.fixture(scope="module")
def tiny(tmp_path_factory):
    """A vocabulary of all bytes and a few longer pieces, one of them very long."""
    pieces = [bytes([k]) for k in range(256)] + [b"th", b"the", b" th", b"he", b"in", b" i", b"ing", b"en", b"n" * 30, "\u00e9".encode()]
    path = tmp_path_factory.mktemp("v") / "tiny.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % k for k, p in enumerate(pieces)))
    return str(path), pieces


def cuts_of(raw, pieces, at=0):
    """Every way to cut ``raw[at:]`` into pieces, as lists of their numbers."""
    if at == len(raw):
        yield []
    for k, p in enumerate(pieces):
        if raw.startswith(p, at):
            for rest in cuts_of(raw, pieces, at + len(p)):
                yield [k, *rest]


def brute_model(rows, pieces, rounds, smoothing=0.01):
    """Expectation maximisation by listing all cuts."""
    langs = sorted({lang for _, lang in rows})
    p = {lang: [1 / len(pieces)] * len(pieces) for lang in langs}
    cuts = {w: list(cuts_of(language_id.encoded(w), pieces)) for t, _ in rows for w in language_id.words_of(t)}
    for _ in range(rounds):
        c = {lang: [smoothing] * len(pieces) for lang in langs}
        for t, lang in rows:
            for w in language_id.words_of(t):
                each = [math.prod(p[lang][k] for k in cut) for cut in cuts[w]]
                for cut, q in zip(cuts[w], each):
                    for k in cut:
                        c[lang][k] += q / sum(each)
        p = {lang: [x / sum(c[lang]) for x in c[lang]] for lang in langs}
    return langs, p


def test_language_against_all_cuts(spark, tiny):
    path, pieces = tiny
    texts = {"aa": ["the thing then", "in the inn the", "nothing"], "bb": ["ein ein \u00e9t\u00e9 e\u0301", "nein nie", "hin"]}
    rows = [(k * 10 + n, t, lang) for k, (lang, own) in enumerate(texts.items()) for n, t in enumerate(own * 3)]
    learned = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    langs, p = brute_model(learned, pieces, 3)
    model = language_id.fit(frame(spark, rows), vocabulary=path, rounds=3)
    assert model.langs == langs
    for k, lang in enumerate(langs):
        assert np.allclose(model.p[:-1, k], p[lang], rtol=1e-6)
    asked = [(100, "nothing then", None), (101, "\u00e9 ein", None), (102, "z", None), (103, "9", None), (104, None, None)]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows + asked), model).collect()}
    for i, t, _ in rows + asked:
        words = language_id.words_of(t or "")
        logs = [sum(math.log(sum(math.prod(p[lang][k] for k in cut) for cut in cuts_of(language_id.encoded(w), pieces))) for w in words) for lang in langs]
        want = 1 / sum(math.exp(x - max(logs)) for x in logs) if words else 0.0
        assert got[i].lang_pred == (langs[logs.index(max(logs))] if words else "und") and abs(got[i].score - want) < 1e-6


def test_long_words(tiny):
    """Words of any length, along their places and by length, with sums far below what a double holds."""
    path, pieces = tiny
    vocab = language_id.pieces(path)
    rng = np.random.default_rng(4)
    p = np.vstack([rng.random((vocab.n, 2)) ** 8 * 1e-9, np.zeros(2)])
    model = language_id.Model(["a", "b"], p, path)
    words = ["the" * 15, "n" * 62, "n" * 63, "n" * 64, "n" * 200, "thing" * 400]
    a = model.word_scores(words)
    assert np.isfinite(a).all() and a[-1].max() < -10_000
    raw, lang, n = [language_id.encoded(w) for w in words], np.array([0, 1] * 3), np.arange(1, 7)
    x = language_id.expected(vocab, raw, lang, n, p)
    exact = [[Fraction(q) for q in p[:, k]] for k in (0, 1)]
    for w, own in zip(raw, a):
        for k in (0, 1):
            f = [Fraction(1)]
            for j in range(1, len(w) + 1):
                f.append(sum((f[j - len(q)] * exact[k][z] for z, q in enumerate(pieces) if len(q) <= j and w[j - len(q) : j] == q), Fraction(0)))
                if len(w) > 400 and j > 60:
                    break
            if len(f) == len(w) + 1:
                want = math.log(f[-1].numerator) - math.log(f[-1].denominator)
                assert abs(own[k] - want) < 1e-9 * abs(want)
    size = np.array([len(q) for q in pieces] + [0])
    assert np.isclose((x.sum(1) * size).sum(), sum(len(w) * k for w, k in zip(raw, n)))  # the pieces cover every byte
    text = "the thing " * 300_000  # cut into sections
    entered = sum(model._sum(model._enter([x])[0]) for x in language_id.sections(text))
    assert np.allclose(entered, 300_000 * model._sum(model._enter(["the thing "])[0]))
    assert model.predict([text, "the thing", "the " + "n" * 500])[0] == [model.predict([x])[0][0] for x in (text, "the thing", "the " + "n" * 500)]


def test_words_are_scored_once(tiny):
    """Words that come again are not scored again: in other cases and signs, and when the table has been full."""
    p = np.vstack([np.random.default_rng(8).random((len(tiny[1]), 2)) * 0.01, np.zeros(2)])
    model, scored = language_id.Model(["a", "b"], p, tiny[0]), []
    model.capacity, plain = 1000, model.word_scores
    model.word_scores = lambda words: scored.extend(words) or plain(words)
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    common = [name(k) for k in range(300)]
    for b in range(8):
        own = [name(1000 + 400 * b + k) for k in range(400)]
        texts = [" ".join(common + own), ", ".join(w.title() for w in common + own) + ".", "(" + "-".join(common) + ")", "n" * 70]
        lang, score = model.predict(texts)
        for t, one, s in zip(texts, lang, score):
            logs = plain(language_id.words_of(t)).sum(0)
            assert one == "ab"[logs.argmax()] and math.isclose(s, 1 / np.exp(logs - logs.max()).sum())
    short = [w for w in scored if len(w) < 70]
    assert sorted(short) == sorted(common + [name(1000 + k) for k in range(3200)])
    assert len(model.row) + len(model.aside[0]) <= 2000


def test_marks_and_ties(spark, tiny):
    assert language_id.words_of("\u0e17\u0e35\u0e48 \u0915\u093f e\u0301 a-b9c") == ["\u0e17\u0e35\u0e48", "\u0915\u093f", "e\u0301", "a", "b", "c"]
    p = np.vstack([np.full((len(tiny[1]), 3), 0.001), np.zeros(3)])
    model = language_id.Model(["a", "b", "c"], p, tiny[0])
    assert model.predict(["some text"])[0] == ["a"] and abs(model.predict(["some text"])[1][0] - 1 / 3) < 1e-12
    rows = frame(spark, [(1, "some text", "a"), (1, "some text", "a"), (2, "9", "a")]).withColumnRenamed("sig", "guess")
    kept = language_id.keep_identified(rows, model, least=0.3)
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    with pytest.raises(ValueError):
        language_id.fit(frame(spark, [(k, "x", f"l{k}") for k in range(9)]), most_langs=3)


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, docs_per_lang=60, rounds=3)
    extra = frame(spark, [(1, None, "en"), (2, "", "en"), (3, "123 456 !!", "en"), (None, "the and of to", None), (5, "x" * 3000, "xx")])
    got = language_id.identify(docs.select("doc_id", "text", "lang").unionByName(extra.select("doc_id", "text", "lang")), model).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    big = [r for r in got if r.doc_id not in (None, 1, 2, 3, 5)]
    held = [r for r in big if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in big) and held
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    odd = language_id.identify(extra, model).collect()
    assert [(r.lang_pred, r.score) for r in odd if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [r.held_out for r in odd if r.doc_id is None] == [False]
    assert {r.doc_id for r in language_id.keep_identified(extra, model).collect()} <= {None, 5}
    none = language_id.fit(extra.where("false"))
    assert [r.lang_pred for r in language_id.identify(extra, none).collect()] == ["und"] * 5
    assert not math.isnan(sum(r.score for r in odd))
