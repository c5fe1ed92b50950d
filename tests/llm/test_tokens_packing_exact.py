"""Token counts and packing against the library and exact invariants; exact dedup against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from searchloom.llm import exact_dedup, packing, token_counts
from searchloom.llm import tokenizer as tok

TK = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, t string, item long"
TEXTS = [
    None, "", " ", "Hello, World.", "hello world", "It's a test... don't!", "a b c", "x<|endoftext|>y <|startoftext|>",
    "été İstanbul STRASSE Straße ΣΟΦΟΣ", "\x1c\x1d a\x0bb\x85c", "word " * 9000, "z" * 30000, "1,000 9/11 \U0001f600 ok", "Hello, World.",
    "tab\tnew\nline\r\nend,", "a,. b.; 'S 'tis", "Hello,  World.",
]


def rows(texts):
    return [(i, t, "en", "s", 0, "x", "y", 1) for i, t in enumerate(texts)]


def ids(t):
    return TK.encode(t or "", add_special_tokens=False).ids


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \n\t\x0b.,;!'<|>aBsZİé́"))), max_size=60))
@settings(max_examples=400, deadline=None)
def test_parts_equal_whole(text):
    assert tok.encoder("word_bpe_49k.json").ids(text).tolist() == ids(text)


def test_parts_of_all_letters():
    """Every letter at the end of a word, before each mark, in both cases."""
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    letters = [c for c in letters if c < "\u3400"] + letters[:: 97]
    texts = [" ".join(f"{w}{c}{m}" for c in letters[k : k + 500]) for w in ("", "AL") for m in ("", ".", ",", "!") for k in range(0, len(letters), 500)]
    enc = tok.Encoder("word_bpe_49k.json")
    for t, want in zip(texts, TK.encode_batch_fast(texts, add_special_tokens=False)):
        assert enc.ids(t).tolist() == want.ids


def test_latin_words_by_model():
    """Words of ASCII and Latin-1 letters need no normaliser; all others go through the library whole."""
    enc = tok.Encoder("word_bpe_49k.json")
    whole, sent = enc._words, []
    enc._words = lambda words: sent.extend(words) or whole(words)
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    text = " ".join([f"{a}{b}" for a in letters for b in letters] + ["Straße", "ÉTÉ,", "ÀÉÎõü", "µm", "ΣΟΦΟΣ", "e\u0301t", "ÿĀ"])
    assert enc.ids(text).tolist() == ids(text)
    assert set(sent) <= {"ΣΟΦΟΣ", "ÿĀ"}


def test_full_table_is_drawn_from(monkeypatch):
    """Words met again and again are encoded once, however often the table fills."""
    monkeypatch.setattr(tok, "TABLE_ENTRIES", 60)
    enc, sent = tok.Encoder("word_bpe_49k.json"), []
    for name in [n for n in ("_words", "_latin_words") if hasattr(enc, n)]:
        monkeypatch.setattr(enc, name, lambda words, own=getattr(enc, name): sent.extend(words) or own(words))
    for k in range(40):
        text = f"common, words Again und wieder. {' '.join('n' + 'abcdefghij'[k % 10] * (j + 1) + 'xyzw'[k // 10] for j in range(9))}"
        assert enc.ids(text).tolist() == ids(text)
    assert sent.count("common") == sent.count("again") == 1 and len(enc.table) <= 60 + 30


def test_documents_as_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()
    enc = tok.Encoder("word_bpe_49k.json")
    for r, want in zip(docs, TK.encode_batch_fast([r.text or "" for r in docs], add_special_tokens=False)):
        assert enc.ids(r.text).tolist() == want.ids


def test_counts(spark, tmp_path):
    df = spark.createDataFrame(rows(TEXTS), SCHEMA)
    for _ in range(2):  # the second time all are in the cache
        got = {r.doc_id: r for r in token_counts.token_counts(df, cache_path=str(tmp_path / "c")).collect()}
        for i, t in enumerate(TEXTS):
            assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(ids(t))), i
            assert got[i].over_limit == (len(ids(t)) > 2048)
    one = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, batches=5).collect()}  # batches meet what earlier ones stored
    assert one == {i: len(ids(t)) for i, t in enumerate(TEXTS)}
    cached = spark.read.parquet(str(tmp_path / "c"))
    assert cached.count() == len({t or "" for t in TEXTS})
    more = spark.createDataFrame(rows(TEXTS + ["new one"]), SCHEMA)
    assert token_counts.token_counts(more, cache_path=str(tmp_path / "c")).count() == len(TEXTS) + 1
    assert spark.read.parquet(str(tmp_path / "c")).count() == cached.count() + 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    t = ["Hello, World. It's", None, "café \U0001f600"]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(rows(t), SCHEMA), tokenizer=name).collect()}
    enc = tok.Encoder(name)
    assert [got[i] for i in range(3)] == [len(enc._direct([x])[0]) if x else 0 for x in t]


def check_packing(out, texts, capacity=4096):
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        want = np.array(ids(t) + [1], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(want) // capacity)))
        for r in got:
            part = want[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length == min(capacity, len(want) - r.start)
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing(spark):
    texts = TEXTS + [f"w{i} " * (i * 37 % 1500) for i in range(120)]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    total = sum(len(ids(t)) + 1 for t in texts)
    n = check_packing(packing.pack(df, node_items=10).collect(), texts)
    assert n <= 1.12 * -(-total // 4096)  # tiny nodes; at production size the waste is under one percent
    same = spark.createDataFrame([(None if k % 2 else 5, "w " * 2500, *["x"] * 2, 0, "x", "y", 1) for k in range(90)], SCHEMA)  # equal rows, no two fit together
    out = packing.pack(same, node_items=8).collect()
    assert len(out) == 90 == len({r.sequence_id for r in out})
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty).collect() == [] and token_counts.token_counts(empty).collect() == []
    assert [(r.doc_id, r.length) for r in packing.pack(spark.createDataFrame([(None, None, *["x"] * 2, 0, "x", "y", 1)], SCHEMA)).collect()] == [(None, 1)]


def test_best_fit():
    assert packing.best_fit([7, 5, 5, 3], 10) == [0, 1, 1, 0]
    assert packing.best_fit([], 10) == []


def test_exact_dedup(spark):
    texts = TEXTS + ["dup"] * 40 + ["a  b", "a b", "a\n\tb"]
    data = rows(texts)[::-1] + [(None, "only null id", *["x"] * 2, 0, "x", "y", 1), (None, "dup", *["x"] * 2, 0, "x", "y", 1), (3, "Hello, World.", *["x"] * 2, 0, "x", "y", 1)]
    data += [(21, "thrice", *["x"] * 2, 0, "x", "y", 1)] * 3
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in data:
        groups.setdefault(norm(r[1]), []).append(r[0])
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    out = exact_dedup.exact_dedup(df, salts=3).collect()
    assert len(out) == len(data)
    want = []
    for i, t, *_ in data:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    weak = lambda t: F.substring(F.sha2(t, 256), 1, 1)  # noqa: E731 - many texts of one digest
    assert sorted(map(tuple, exact_dedup.exact_dedup(df, salts=3, digest=weak).collect()), key=key) == sorted(want, key=key)
    left = [(i, norm(t)) for i, t, *_ in data if i == min((x for x in groups[norm(t)] if x is not None), default=None)]
    for options in ({}, {"digest": weak}):
        kept = exact_dedup.drop_copies(df, **options)
        assert kept.columns == df.columns and sorted(((r.doc_id, norm(r.text)) for r in kept.collect()), key=str) == sorted(set(left), key=str)
    clash = df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("text_sha", "keep_id", "keep_sha", "sha", "digest")])
    assert exact_dedup.drop_copies(clash).columns == clash.columns and exact_dedup.drop_copies(clash).count() == len(set(left))
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_drop_copies_writes_nothing(spark, monkeypatch):
    """The rows that stay follow from the groups: no scratch table, and the rows move once."""
    written = []
    monkeypatch.setattr(exact_dedup.Scratch, "write", lambda self, df, name: written.append(name) or df)
    df = spark.createDataFrame(rows(["a  b", "a b", None, "", "c"]) + [(0, "a b", "en", "s", 0, "x", "y", 1), (None, "c", "en", "s", 0, "x", "y", 1), (None, "d", "en", "s", 0, "x", "y", 1)], SCHEMA)
    kept = exact_dedup.drop_copies(df)
    assert sorted(((r.doc_id, (r.text or "").split()) for r in kept.collect()), key=str) == [(0, ["a", "b"]), (2, []), (4, ["c"]), (None, ["d"])]
    assert written == []
